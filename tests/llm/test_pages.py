import random
from collections import Counter, defaultdict
from hashlib import sha256

import duckdb
import pytest

from arborlake.llm import linededup, registry, urlfilter, warc
from arborlake.llm.oracle import ORACLE

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def equal(got, want):
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    key = lambda r: [(v is None, str(v)) for v in r]
    assert sorted(map(tuple, got.select(columns).collect()), key=key) == sorted(want.select(*columns).fetchall(), key=key)


@pytest.mark.parametrize("name", ORACLE)
def test_query_equals_sql(spark, db, name):
    equal(registry.QUERIES[name](spark, DATA), db.sql(ORACLE[name]))


SCHEMA = "page_id long, url string, html string, verdict string"


def awkward_pages():
    rnd = random.Random(8)
    host = lambda: rnd.choice(["a.example.net", "EXAMPLE.com", "example.com", "x.org", "org", "net", "notexample.net", "b.test", "c.test", "d.test", "e.test"])
    out = []
    for i in range(120):
        link = f'<link href="http://{host()}{rnd.choice(["", "/en/", "/p1", "/fr/2?q=1#z"])}" rel="canonical">' if rnd.random() < 0.6 else ""
        link = rnd.choice([link, "<LINK rel=canonical href='/p1'>", "<link rel='canonical' href='//c.test/p1?a=1&amp;b=2'>", '<meta http-equiv="Refresh" content="0; URL=http://d.test/p2">', "<link rel=canonical>", "<link rel=canonical href='p2'>", '<link rel="canonical" href="../x/./p1?a=1">', "<link rel=canonical href='?a=1&b=2'>", "<link rel=canonical href='#top'>", "<link rel=canonical href='mailto:x'>", link, link])
        url = f"{rnd.choice(['http', 'https', ''])}://{host()}{rnd.choice(['', '/', '/en/x', '/de/y', '/fr/z', '/p1', '/p1?a=1&b=2', '?q', '#f', '/p2'])}"
        out.append((i, url, f"<p>{i % 7}</p>{link}" + "x" * rnd.choice([0, 200]), "v"))
    alone = (300, "http://solo.test/1", '<link rel="canonical" href="http://blocked.net/solo">', "")
    return out + [alone, (200, None, None, None), (201, "no scheme", "", ""), (None, "http://x.org/fr/1", None, ""), (5, *out[5][1:]), (202, "http://", "x" * 150, ""), (203, "a://b://c/d\n?e", "x" * 150, ""), (None, None, "x" * 150, ""), (None, None, "y" * 150, "")]


def test_pages_with_awkward_values_equal_sql(spark, db):
    rows = awkward_pages()
    con = duckdb.connect()
    con.sql("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR, verdict VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?, ?)", rows)
    pages = spark.createDataFrame(rows, SCHEMA)
    got = urlfilter.judge_urls(pages, registry.URL_RULES)
    equal(got, con.sql(ORACLE["op7_url_filter"]))
    assert {(r.rule is None, r.verdict) for r in got.collect()} == {(True, "allow"), (True, "block"), (False, "allow"), (False, "block")}
    equal(warc.record_columns(warc.read_archive(spark, warc.write_archive(pages))).drop("url"), con.sql(ORACLE["op2_warc_archive"]))
    equal(linededup.drop_boilerplate(pages), con.sql(ORACLE["op8_line_dedup"]))


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert urlfilter.judge_urls(none, registry.URL_RULES).count() == 0 and linededup.drop_boilerplate(none).count() == 0
    assert warc.read_archive(spark, warc.write_archive(none)).count() == 0


def test_allow_takes_precedence_and_redirects_carry(spark):
    pages = spark.createDataFrame([(1, "http://bad.net/x", ""), (2, "http://one.test/", ""), (3, "http://two.test/", ""), (4, "http://three.test/a#b", ""), (5, "https://three.test/a", "")], "page_id long, url string, html string")
    moved = spark.createDataFrame([("http://one.test/", "http://bad.net/x"), ("http://two.test/", "http://bad.net/x"), ("http://three.test/a", "http://two.test/"), (None, "http://two.test/")], "source string, target string")
    judge = lambda m: {r.page_id: r.verdict for r in urlfilter.judge_urls(pages, registry.URL_RULES, m).collect()}
    assert set(judge(moved).values()) == {"block"}
    kept = judge(moved.union(spark.createDataFrame([("http://two.test/", "http://example.net/en/1")])))
    assert kept == {1: "block", 2: "allow", 3: "allow", 4: "allow", 5: "allow"}
    assert set(judge(moved.limit(0)).values()) == {"block", "allow"}


def test_boilerplate_matches_brute_force(spark):
    rnd = random.Random(3)
    rows = [(i, f"http://h{rnd.choice('aab')}/{i}", "<p>".join(rnd.choice(["menu", " menu ", "é", f"own {i}", "rare", ""]) for _ in range(8))) for i in range(80)]
    lines = {i: [x.strip(" ") for x in html.split("<p>") if x.strip(" ")] for i, _, html in rows}
    host = {i: url.split("/")[2] for i, url, _ in rows}
    pages, seen = Counter(host.values()), defaultdict(set)
    for i, found in lines.items():
        for x in found:
            seen[host[i], x].add(i)
    bad = {k for k, v in seen.items() if len(v) >= 2 and len(v) > 0.5 * pages[k[0]]}
    got = linededup.drop_boilerplate(spark.createDataFrame(rows, "page_id long, url string, html string"), ratio=0.5)
    assert {r.page_id: r.text for r in got.collect()} == {i: "\n".join(x for x in found if (host[i], x) not in bad) for i, found in lines.items()}
    assert bad


def test_archive_and_warc_files_round_trip(spark, tmp_path):
    data = "é\r\n\r\nWARC/1.1\r\n" * 20
    pages = spark.createDataFrame([(1, "http://a/\r\nX: y", data), (2, None, data), (3, "u", ""), (4, "v", None), (0, "w", "short"), (9, "z", "short")], "page_id long, url string, html string")
    read = warc.read_archive(spark, warc.write_archive(pages))
    rows = {bytes(r.header): bytes(r.payload) for r in read.collect()}
    assert sorted(rows.values()) == sorted(x.encode() for x in (data, data, "", "", "short", "short"))
    warc.export_warc(read, str(tmp_path / "w"))
    back = {bytes(r.header): bytes(r.content) for r in warc.import_warc(spark, str(tmp_path / "w")).collect()}
    assert set(back) == set(rows) and all(back[h] == (b"" if b"revisit" in h.split(b"\r\n")[1] else rows[h]) for h in rows)
    named = {r.page_id: r for r in warc.record_columns(read).collect()}
    assert named[2].refers_to == 1 and named[1].url == "http://a/%0D%0AX: y" and named[2].payload_digest == sha256(data.encode()).hexdigest()


def test_damage_is_noticed(spark):
    at = warc.write_archive(spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string"))
    spark.table(at.payloads).selectExpr("digest", "cast('other' as binary) AS payload").createOrReplaceTempView("bad")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_archive(spark, warc.Archive(at.folder, "bad", at.headers)).collect()


def test_relative_links(spark):
    base = "http://h.test/a/b/c?x#y"
    cases = {"d": "/a/b/d", "./d": "/a/b/d", "../d": "/a/d", "../../../d": "/d", "/d/./e": "/d/e", "..": "/a/", "?q=1": "/a/b/c?q=1", "d?x=../y#z": "/a/b/d?x=../y"}
    pages = spark.createDataFrame([(base, f"<link rel='canonical' href='{k}'>") for k in [*cases, "#z", "", "mailto:a@b"]], "url string, html string")
    got = [r.b for r in urlfilter.alias_links(pages).collect()]
    assert got == ["h.test" + v for v in cases.values()]
    top = spark.createDataFrame([("http://h.test", "<link rel=canonical href=x>")], "url string, html string")
    assert urlfilter.alias_links(top).first().b == "h.test/x"


def test_many_rules_equal_trying_each(spark):
    rnd = random.Random(4)
    name = lambda: ".".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 5)))
    path = lambda: "/" + "/".join(rnd.choice(["x", "xy", "y"]) for _ in range(rnd.randrange(3)))
    rules = sorted({(rnd.choice(["allow", "block"]), name(), rnd.choice(["", path()])) for _ in range(300)})
    urls = [(i, f"http://{name()}{rnd.choice([':80', '', ''])}{path()}", "") for i in range(400)]
    got = {r.page_id: r for r in urlfilter.judge_urls(spark.createDataFrame(urls, "page_id long, url string, html string"), rules).collect()}
    for i, url, _ in urls:
        host, _, rest = url[7:].partition("/")
        fits = [(len(n + p), n + p, a == "allow", a) for a, n, p in rules if (host == n or host.endswith("." + n)) and ("/" + rest).startswith(p)]
        best = max(fits, default=(0, None, True, "allow"))
        assert (got[i].rule, got[i].verdict) == (best[1], best[3]), url
    assert {r.verdict for r in urlfilter.judge_urls(spark.createDataFrame(urls, "page_id long, url string, html string"), []).collect()} == {"allow"}


def test_hot_payloads_and_small_hosts(spark):
    rows = [(i, f"http://h{i % 3}.test/{i}", None if i % 3 else "same page " * 20) for i in range(900)] + [(1000 + i, f"http://one{i}.test/", f"<p>only {i}") for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    out = warc.record_columns(warc.read_archive(spark, warc.write_archive(pages))).collect()
    assert len(out) == 930 and sum(r.record_type == "revisit" for r in out) == 299 and {r.refers_to for r in out} == {None, 0}
    assert all(r.n_dropped == 0 for r in linededup.drop_boilerplate(pages).where("page_id >= 1000").collect())
