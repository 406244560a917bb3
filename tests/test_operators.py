import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from arborlake import relation
from arborlake.functions.calendar import Boundaries
from arborlake.functions.paths import parse_extensions
from arborlake.operators import aggregate, duplicates, filters, folders, listing

MB = 1 << 20
DAY = 86_400_000
ROOT = "/mnt/c"


def rows(df, *by):
    return [tuple(r) for r in df.orderBy(*by).collect()] if by else [tuple(r) for r in df.collect()]


def files(spark, data):
    return spark.createDataFrame(data, "extension string, size long, mtime_ms long")


def test_by_extension_order(spark):
    got = rows(aggregate.by_extension(files(spark, [("txt", 500, 0), ("mp4", 1_000_000, 0), ("jpg", 10, 0), ("b", 10, 0), ("a", 10, 0)])), "rank")
    assert [r[0] for r in got] == ["mp4", "txt", "a", "b", "jpg"]


def test_size_buckets_are_dense(spark):
    got = rows(aggregate.by_size_bucket(files(spark, [("a", 1024, 0), ("a", 21 * MB, 0)])), "ordinal")
    assert [r[2:] for r in got] == [(1, 1024), (0, 0), (0, 0), (1, 21 * MB), (0, 0)]
    assert [r[2:] for r in rows(aggregate.by_size_bucket(files(spark, [])), "ordinal")] == [(0, 0)] * 5


def test_dates_are_nested(spark):
    b = Boundaries.of(date(2024, 7, 3))  # a Wednesday; its week began on June 30
    times = [b.today, b.tomorrow - 1, b.tomorrow, b.today + 365 * DAY, b.today - 1, b.week, b.month, b.year, b.year - 1, 1_500_000_000_000]
    got = rows(aggregate.by_date(files(spark, [("a", 1, t) for t in times]), b), "ordinal")
    assert [r[1:3] for r in got] == [("today", 2), ("this week", 4), ("this month", 4), ("this year", 6)]
    assert rows(aggregate.by_prior_year(files(spark, [("a", 1, t) for t in times]), b), "year") == [(2017, 1, 1), (2023, 1, 1)]
    table = rows(aggregate.date_table(files(spark, [("a", 1, t) for t in times]), b))
    assert [r[1] for r in table] == ["today", "this week", "this month", "this year", "2023", "2017"]


def test_early_january_week_is_clipped(spark):
    b = Boundaries.of(date(2024, 1, 2))  # the week began in 2023
    got = rows(aggregate.by_date(files(spark, [("a", 1, b.week), ("a", 1, b.year)]), b), "ordinal")
    assert [r[2] for r in got] == [0, 1, 1, 1]


def test_totals_and_cube(spark):
    f = files(spark, [("a", 5, 0), ("b", 5000, 9e15.__int__())])
    assert rows(aggregate.totals(f)) == [(2, 5005)] and rows(aggregate.totals(files(spark, []))) == [(0, 0)]
    assert sorted(rows(aggregate.report_cube(f))) == [("bucket", "<= 1KB", 1, 5), ("bucket", "> 1KB and <= 1MB", 1, 5000), ("extension", "a", 1, 5), ("extension", "b", 1, 5000), ("total", "total", 2, 5005)]


def test_filters_charge_size_first(spark):
    data = [("file", "jpg", 10), ("file", "jpg", 4096), ("file", "txt", 4096), ("inaccessible_dir", None, None), ("inaccessible_file", None, None)]
    df = spark.createDataFrame(data, "entry_kind string, extension string, size long")
    tally = filters.filter_tally(df, 1024, parse_extensions("txt")).first().asDict()
    assert tally == {"size_skipped_n": 1, "size_skipped_bytes": 10, "ext_skipped_n": 1, "ext_skipped_bytes": 4096, "inaccessible_dirs": 1, "inaccessible_files": 1}
    out, seen = filters.filtered(df, 1024, parse_extensions("txt"))
    assert out.count() == 1 and seen.get == tally


def test_filter_extensions_and_size(spark):
    df = spark.createDataFrame([("README", 1), ("a.txt", 1023), ("b.jpg", 1024)], "path string, size long")
    df = relation.with_extension(df)
    assert {r.path for r in filters.with_extensions(df, parse_extensions("txt,none")).collect()} == {"README", "a.txt"}
    assert [r.path for r in filters.at_least(df, 1024).collect()] == ["b.jpg"]


def tally(spark, data):
    return spark.createDataFrame([(f"{ROOT}/{k}" if k else ROOT, n, b) for k, n, b in data], "folder string, count long, bytes long")


def shown(spark, data, least):
    out = folders.without_pass_through(folders.roll_up(tally(spark, data), ROOT), ROOT)
    out = out.where((F.col("folder") == ROOT) | (F.col("bytes") >= least)).orderBy(F.desc("bytes"), "folder")
    return [(r.folder.removeprefix(ROOT).removeprefix("/"), r["count"], r.bytes) for r in out.collect()]


def test_roll_up(spark):
    assert shown(spark, [("c1", 3, 60 * MB), ("c2/x", 4, 120 * MB), ("c2/y", 1, 2 * MB)], 50 * MB) == [("", 8, 182 * MB), ("c2", 5, 122 * MB), ("c2/x", 4, 120 * MB), ("c1", 3, 60 * MB)]
    assert shown(spark, [("small", 1, 10)], 1 << 30) == [("", 1, 10)]
    assert shown(spark, [("b", 1, 100), ("a", 1, 100)], 0) == [("", 2, 200), ("a", 1, 100), ("b", 1, 100)]
    assert shown(spark, [], 0) == [("", 0, 0)]


def test_pass_through_chains(spark):
    got = [x[0] for x in shown(spark, [("ug5/resources/app", 134, 71 * MB), ("ug5", 1, 1000), ("sibling", 1, 5 * MB)], 0)]
    assert "ug5/resources/app" not in got and {"ug5", "ug5/resources"} <= set(got)
    assert {"p", "p/child"} <= {x[0] for x in shown(spark, [("p", 1, 10 * MB), ("p/child", 1, 70 * MB), ("sibling", 1, MB)], 0)}


def test_roll_up_is_the_prefix_sum(spark):
    rnd = random.Random(4)
    paths = ["/r/" + "/".join(rnd.choices("abc", k=rnd.randrange(1, 6))) + f"/f{i}" for i in range(300)]
    df = spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "path string, size long")
    got = {r.folder: (r["count"], r.bytes) for r in folders.roll_up(folders.direct(df), "/r").collect()}
    want = {}
    for i, p in enumerate(paths):
        parts = p.split("/")[2:-1]
        for k in range(len(parts) + 1):
            f = "/".join(["/r", *parts[:k]])
            n, b = want.get(f, (0, 0))
            want[f] = n + 1, b + i
    assert got == want


def sized(spark, data):
    return spark.createDataFrame([(k, 1, v) for k, v in data.items()], "folder string, count long, bytes long")


def test_growth(spark):
    base = sized(spark, {"a": 100 * MB, "same": 100 * MB, "edge": 100 * MB, "zero": 0, "gone": 5})
    now = sized(spark, {"a": 125 * MB, "same": 105 * MB, "edge": 110 * MB, "zero": 20 * MB, "new": 500 * MB})
    assert rows(folders.growth(base, now, 10)) == [("a", 100 * MB, 125 * MB, 25.0)]
    assert rows(folders.appeared(base, now), F.desc("bytes")) == [("new", 1, 500 * MB), ("zero", 1, 20 * MB)]


P = b"x" * 4096


@pytest.mark.parametrize(
    "data,want",
    [
        ([("a", b"same", 1), ("b", b"same", 2)], [["a", "b"]]),
        ([("a", b"alpha", 1), ("b", b"bravo", 2)], []),
        ([("a", P + b"tail-A", 1), ("b", P + b"tail-B", 2)], []),
        ([("b", b"shared", 1), ("a", b"shared", 2), ("c", b"unique", 3)], [["a", "b"]]),
        ([("a", b"same", 1), ("b", b"same", 1), ("c", b"same", 2)], [["a", "c"]]),
        ([("a", b"same", 1), ("b", b"same", 1)], []),
        ([("a", b"", 1), ("b", b"", 2)], []),
        ([("a", b"same", None), ("b", b"same", None)], [["a", "b"]]),
    ],
)
def test_duplicates(spark, data, want):
    df = spark.createDataFrame([(p, len(c), bytearray(c), 1, i) for p, c, i in data], "path string, size long, content binary, dev long, ino long")
    names = duplicates.one_name_per_inode(duplicates.content_digests(duplicates.same_size(df)))
    got = {}
    for r in duplicates.members(names).orderBy("digest", "position").collect():
        got.setdefault(r.digest, []).append(r.path)
    assert list(got.values()) == want
    assert sorted(r.path for r in duplicates.redundant(names).collect()) == sorted(p for g in want for p in g[1:])
    s = duplicates.summary(duplicates.groups(names)).first()
    assert (s.groups, s.redundant_files) == (len(want), sum(len(g) - 1 for g in want))


def test_listing_orders(spark):
    df = spark.createDataFrame([("/z", 2048, 5), ("/a", 1, 7), ("/b", 1, 5)], "path string, size long, mtime_ms long")
    assert [r.path for r in listing.listing(df).collect()] == ["/a", "/b", "/z"]
    assert [r.path for r in listing.listing(df, "size").collect()] == ["/z", "/a", "/b"]
    assert [r.path for r in listing.listing(df, "date").collect()] == ["/a", "/b", "/z"]
    assert [r.path for r in listing.listing(df, "size", True).collect()] == ["/a", "/b", "/z"]
    assert [(r.rank, r.path) for r in listing.ranked(df, "size").orderBy("rank").collect()] == [(1, "/z"), (2, "/a"), (3, "/b")]
    assert listing.display(df, "date").columns == ["modified", "size", "path"]


def test_relation_is_checked(spark):
    with pytest.raises(TypeError, match="mtime_ms is missing"):
        relation.check_relation(spark.createDataFrame([("a", 1)], "path string, size long"))
