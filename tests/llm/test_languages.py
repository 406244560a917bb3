import math
import random
import resource

import duckdb
import numpy as np
from pyspark.sql import functions as F

from arborlake.llm import langid


def identified(spark, rows, model, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, suffix string")
    out = langid.identify(df, model, F.col("text"), F.col("lang"), F.col("source"), F.col("suffix"), **how)
    assert out.columns[:5] == df.columns
    return {r.doc_id: r for r in out.collect()}


def labelled(sf="0.001"):
    return duckdb.sql(f"SELECT doc_id, lang, text, source FROM '/root/testdata/sf{sf}/documents.parquet' ORDER BY doc_id").fetchall()


def test_held_out_accuracy(spark):
    rows = labelled("0.01")
    model = langid.train([(x[1], x[2]) for x in rows if x[0] % 3])
    held = [(d, text, None, source, None) for d, _, text, source in rows if d % 3 == 0]
    got, truth = identified(spark, held, model), {x[0]: x[1] for x in rows}
    assert sum(r["language"] == truth[d] for d, r in got.items()) >= 0.97 * len(got)
    assert sum(r["accepted"] for r in got.values()) >= 0.98 * len(got)


def test_evidence_is_combined(spark):
    model = langid.train([(x[1], x[2]) for x in labelled()])
    host = [(i, "the and of that with this is " * 5, None, "h.test", "test") for i in range(40)]
    odd = [
        (100, None, "en", "h.test", "test"), (101, " ", None, None, None), (102, "", "en", None, None), (103, "12", "en", "h.test", "test"), (104, "12", "de", "other", None),
        (105, "the and of that with this is " * 50, "de", None, None), (106, "\u4e2d\u6587" * 400, None, None, None), (107, "x", "xx", "h.test", "test"), (None, "the of and", None, None, None),
    ]
    got = identified(spark, [*host, *odd], model)
    assert [got[i]["language"] for i in (100, 101, 102)] == [langid.NONE] * 3 and not any(got[i]["accepted"] for i in (100, 101, 102))
    assert got[103]["language"] == "en" and got[104]["language"] == "de"  # hardly any text: host and declaration decide
    assert got[105]["language"] == "en"  # much text against one declaration
    assert got[106]["language"] == langid.NONE and not got[106]["accepted"]
    assert got[107]["language"] == "en" and got[0]["confidence"] > 0.9


def test_pages_and_markup(spark):
    df = spark.createDataFrame([("<html lang='fr-CA'>",), ('<HTML class=x LANG="De">',), ("<html>",), (None,), ("<p lang=en>",)], "html string")
    assert [r[0] for r in df.select(langid.markup_language(F.col("html"))).collect()] == ["fr", "de", None, None, None]
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = langid.page_languages(pages)
    assert got.columns == [*pages.columns, *langid.FOUND]
    assert got.where("accepted AND language = declared").count() >= 0.97 * pages.count()


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert langid.document_languages(none).count() == 0
    assert langid.document_languages(spark.createDataFrame([(1, None, None, None, 0), (1, "a", None, None, 0)], none.schema)).count() == 2


def test_rare_languages_have_a_class(spark):
    rows = [(i, f"the and of that with this is number {i}", "en", "h") for i in range(12_000)]
    rows += [(20_000 + i, f"och att det som en på är för av nummer {i}", "sv", "h") for i in range(12)]
    rows += [(30_000 + i, "ja se on ei että oli hän mutta " * 1500 + str(i), "fi", "h") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    sample = langid.training_sample(df, F.col("text"), F.col("lang"))
    assert len(sample) < 9000 and langid.train(sample).languages == ("en", "fi", "sv", langid.NONE)
    got = {r.doc_id: r for r in langid.document_languages(df).where("doc_id >= 20000").collect()}
    assert all(r["accepted"] and r["language"] == ("sv" if d < 30_000 else "fi") for d, r in got.items()) and len(got) == 24


def test_fusion_against_brute_force(spark):
    """The posterior written out again from the model's text scores alone."""
    rnd, rows = random.Random(5), []
    texts = ["the and of that", "der die und das", "le la et les", "x", "", None]
    for i in range(200):
        host = rnd.choice(["a.org", "b.org", "c.net", None])
        rows.append((i, " ".join([rnd.choice(texts) or ""] * rnd.randrange(1, 4)) if i % 9 else None, rnd.choice(["en", "de", "zz", None]), host, host and host[-3:]))
    model = langid.train([(x[1], x[2]) for x in labelled()])
    n, blank = len(model.languages), [not (r[1] or "").strip() for r in rows]
    ll = [model.score((r[1] or "").encode()) for r in rows]
    own = [np.zeros(n) if b else np.exp(0.3 * (x - x.max())) / np.exp(0.3 * (x - x.max())).sum() for x, b in zip(ll, blank)]
    root = (sum(own) + 1) / (blank.count(False) + n)
    got = identified(spark, rows, model)
    for i, r in enumerate(rows):
        if blank[i]:
            assert (got[i].language, got[i].confidence, got[i].accepted) == (langid.NONE, 0.0, False)
            continue
        kin = [j for j in range(200) if rows[j][4] == r[4]]
        parent = (sum(own[j] for j in kin) + 10 * root) / (sum(not blank[j] for j in kin) + 10)
        mates = [j for j in kin if rows[j][3] == r[3] and j != i]
        prior = (sum((own[j] for j in mates), np.zeros(n)) + 10 * parent) / (sum(not blank[j] for j in mates) + 10)
        said = [0.0 if r[2] not in model.languages else math.log(0.9) if x == r[2] else math.log(0.1 / (n - 1)) for x in model.languages]
        logit = 0.3 * ll[i] + np.array(said) + np.log(prior)
        want = np.exp(logit - logit.max()) / np.exp(logit - logit.max()).sum()
        assert got[i].language == model.languages[int(want.argmax())] and abs(got[i].confidence - want.max()) < 1e-5


def test_results_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = docs.unionAll(docs.where("doc_id % 3 = 0"))
    one, two = (sorted(map(tuple, langid.document_languages(d, keep=["doc_id"]).collect())) for d in (docs.coalesce(1), docs.repartition(7)))
    assert one == two


def test_many_tags_stay_small():
    rows = [(f"t{i}", f"words of page {i}") for i in range(8000)] + [("en", "the and of that")] * 20
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert langid.train(rows).languages == ("en", langid.NONE)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000  # kilobytes


def test_columns_of_any_name(spark):
    names = ["lang", "a.b", "__ll", "__host", "__text", "__own", "k0", "c1", "language", "accepted", "source", "text", "doc_id"]
    rows = [("en", *range(9), "h", t, i) for i, t in enumerate(["the and of that with this is " * 9, None, "", "12"])]
    df = spark.createDataFrame(rows * 12, ", ".join(f"`{n}` int" if n not in ("lang", "source", "text") else f"{n} string" for n in names))
    out = langid.document_languages(df)
    assert out.columns == [*names, *langid.FOUND] and sorted({r[:13] for r in out.collect()}, key=str) == sorted(rows, key=str)
    kept = langid.accepted_documents(df)
    assert kept.columns == names and {tuple(r) for r in kept.collect()} == {rows[0], rows[3]}
