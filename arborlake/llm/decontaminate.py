"""Benchmark passages in documents, by a prefix-filtered set join over item-sized windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.llm import passages
from arborlake.llm.text import alnum_words
from arborlake.runtime import durable


def _passages(rows: list, windows: tuple[tuple[int | None, float], ...]) -> list[passages.Passage]:
    return [passages.Passage(tuple(alnum_words(bytes(r.text))), t, r.id, w) for w, t in windows for r in rows]


def _merged(spans: set[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


def _row(n: int, matches) -> tuple:
    spans, ids = set(), set()
    for owner, start, end, _ in matches:
        spans.add((start, end))
        if owner is not None:
            ids.add(owner)
    merged = _merged(spans)
    return n, [x for x, _ in merged], [x for _, x in merged], sorted(ids)


_SCHEMA = "n_words long, starts array<long>, ends array<long>, items array<string>"


def benchmark_matches(
    docs: DataFrame, items: DataFrame, keep: list[str], windows: tuple[tuple[int | None, float], ...] = ((10, 1.0),), shingle: int = 5
) -> DataFrame:
    """One row per document: ``keep``, n_words, starts, ends (merged word spans hit), items (matching ids as strings).

    windows: pairs of window length and threshold. Each run of that many words of an item (all of it if it has
    fewer; None: always all of it) is a query: with threshold 1 its words must stand in a document
    consecutively, below 1 a run of as many words must hold that part of its distinct shingles (its span is
    from the first to the last of them). Null and empty texts have no words, hence no matches; items without id hit words but are not named, repeated ones
    count once. Repeated documents give repeated rows. More items than one block are joined block by
    block, each against all documents, and merged by row.
    """
    blocks = iter(passages.item_blocks(items))
    first = next(blocks)
    second = next(blocks, None)
    if second is None:
        return passages.match_queries(docs, _passages(first, windows), shingle, keep, _row, _SCHEMA)
    base = durable(docs.select(*keep, "text", F.monotonically_increasing_id().alias("__row")), "documents")
    parts = None
    for rows in [first, second, *blocks]:
        part = durable(passages.match_queries(base, _passages(rows, windows), shingle, ["__row"], _row, _SCHEMA), "block")
        parts = part if parts is None else parts.unionAll(part)
    spans = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("starts", "ends"))))
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_list("items"))))
    merged = parts.groupBy("__row").agg(F.max("n_words").alias("n_words"), spans.alias("s"), names.alias("items"))
    none = F.expr("cast(array() as array<struct<starts:bigint,ends:bigint>>)")
    merged = merged.withColumn("s", F.aggregate("s", none, _grown))
    merged = merged.select(F.col("__row").alias("__r"), "n_words", F.col("s.starts").alias("starts"), F.col("s.ends").alias("ends"), "items")
    return base.select(*keep, "__row").join(merged, F.col("__row") == F.col("__r")).select(*keep, "n_words", "starts", "ends", "items")


def _grown(spans: Column, x: Column) -> Column:
    """``spans`` with one more span, which starts no earlier than they do, merged with the last where they meet."""
    last = F.element_at(spans, -1)
    wider = F.struct(last["starts"].alias("starts"), F.greatest(last["ends"], x["ends"]).alias("ends"))
    meets = (F.size(spans) > 0) & (x["starts"] <= last["ends"])
    return F.when(meets, F.concat(F.slice(spans, 1, F.size(spans) - 1), F.array(wider))).otherwise(F.concat(spans, F.array(x)))


def contamination_digest(matches: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated from :func:`benchmark_matches`."""
    n_hit = F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    digest = F.sha2(F.array_join("items", ","), 256)
    return matches.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        digest.alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(
    docs: DataFrame, items: DataFrame, windows: tuple[tuple[int | None, float], ...] = ((10, 1.0), (None, 0.8)), shingle: int = 5
) -> DataFrame:
    """``docs`` without the documents that hold a passage of the benchmark; all columns kept, whatever their names.

    By default that is ten consecutive words of an item, or a run of words of its size with 0.8 of its five-word shingles.
    """
    for n, rows in enumerate(passages.item_blocks(items)):
        if n:  # what the blocks before have kept is the next one's input
            docs = durable(docs, "uncontaminated")
        docs = passages.filter_unmatched(docs, _passages(rows, windows), shingle)
    return docs

