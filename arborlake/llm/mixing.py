"""Mixing sources to target weights: water-filled targets and pivotal dependent rounding.

Each document of a source is to be taken target / size-of-source times: a whole number of copies plus a
fraction. The fractions are rounded in pairs: words move from one document's fraction to the other's, in a
random direction with odds that keep both expectations, until one of them is 0 or 1. The words
taken in all never change, but for one last document a source. Leaves of a bounded number of documents are
rounded at once; what is left of each leaf (one document) is rounded again in groups, up a tree.
All draws are hashes of the documents, so reruns agree however rows are partitioned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlake.llm.text import positional, release
from arborlake.runtime import durable, small_side

#: Documents in a leaf of the reduction tree, and residuals combined by one inner node.
LEAF, FAN_IN = 4096, 256
_WHOLE = 1e-9


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, n, target), one row per source.

    Sources by code point, null last, have the weights in turn. Together they get ``share`` times all
    sizes in proportion to weight, each at most ``most`` times its own size, what exceeds that going to the
    others in proportion until none is above. With the sources in order of size to weight, a source is filled
    up if its level is below what would be left for it and all later ones, so the level
    is found by running sums over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    per = durable(per.withColumn("w", weight), "sources").withColumn("cap", F.col("source_size") * float(most))
    level = F.col("cap") / F.col("w")
    by_level = Window.orderBy(level, F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    filled = per.select(
        level.alias("level"),
        ((F.sum("source_size").over(whole) * float(share) - F.coalesce(F.sum("cap").over(by_level), F.lit(0.0))) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(by_level), F.lit(0.0)))).alias("rest"),
    )
    rate = filled.where("rest <= level").agg(F.min(F.struct("level", "rest"))["rest"]).first()[0]
    target = F.col("cap") if rate is None else F.least("cap", F.lit(rate) * F.col("w"))
    return durable(per.select("source", "source_size", "n", target.alias("target")), "targets")


def _draw(order: int, level: int, seed: int) -> float:
    return (xxhash.xxh64_intdigest(order.to_bytes(8, "little", signed=True) + bytes([level]), seed) >> 11) / (1 << 53)


def round_fractions(size: np.ndarray, p: np.ndarray, order: np.ndarray, level: int, seed: int, last: bool) -> np.ndarray:
    """``p`` with all but at most one fraction rounded (none left if ``last``), words kept."""
    p, held = p.copy(), -1
    for i in range(len(p)):
        if p[i] <= _WHOLE or p[i] >= 1 - _WHOLE:
            p[i] = round(p[i])
            continue
        if size[i] == 0:
            p[i] = float(_draw(int(order[i]), level, seed) < p[i])
            continue
        if held < 0:
            held = i
            continue
        up, down = min((1 - p[held]) * size[held], p[i] * size[i]), min(p[held] * size[held], (1 - p[i]) * size[i])
        words = up if _draw(int(order[i]), level, seed) * (up + down) < down else -down
        p[held] += words / size[held]
        p[i] -= words / size[i]
        for k in (held, i):
            if p[k] <= _WHOLE or p[k] >= 1 - _WHOLE:
                p[k] = round(p[k])
        held = next((k for k in (held, i) if 0 < p[k] < 1), -1)
    if last and held >= 0:
        p[held] = float(_draw(int(order[held]), level + 100, seed) < p[held])
    return p


def _rounder(level: int, seed: int, last: bool):
    """Rounds the fractions p of one node of the tree into the copies c."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("order", "ascending"), ("doc_id", "ascending"), ("size", "ascending"), ("h", "ascending")])
        size, p, order = (group.column(c).to_numpy() for c in ("size", "p", "order"))
        p = round_fractions(size.astype(np.float64), p, order, level, seed, last)
        release(group)
        at = group.schema.get_field_index
        group = group.set_column(at("c"), "c", pa.array(group.column("c").to_numpy() + (p == 1)))
        return group.set_column(at("p"), "p", pa.array(np.where(p == 1, 0.0, p)))

    return run


def mix(rows: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 20) -> DataFrame:
    """How often each document is taken: one row per distinct key.

    rows: (doc_id, source, size, h) with h any further identity of a row (a hash of its text). Rows that agree in
    all four are interchangeable: the result has their number m and their copies c together, besides
    source_size and target. Sizes are counts of words, 0 for null; such documents cost nothing and
    are drawn alone. Null sources are a source of their own.
    """
    rows = durable(rows.groupBy("doc_id", "source", "size", "h").agg(F.count("*").alias("m")), "sizes")
    per = source_targets(rows.select("source", (F.col("size") * F.col("m")).alias("size")), weights, share, most)
    same = F.col("source").eqNullSafe(F.col("_source"))
    every = rows.join(small_side(per.withColumnRenamed("source", "_source")), same)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    base = F.floor(rate)
    mass = F.col("m") * (rate - base)
    order = F.xxhash64(F.lit(seed), "doc_id", "size", "h")
    leaf = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "size", "h"), F.greatest(F.ceil(F.col("n") / LEAF), F.lit(1)).cast("long"))
    every = every.select("doc_id", "source", "size", "h", "m", "source_size", "target", (F.col("m") * base + F.floor(mass)).cast("long").alias("c"), (mass - F.floor(mass)).alias("p"), order.alias("order"), leaf.alias("leaf"), F.col("n"))
    widest = (per.agg(F.max("n")).first()[0] or 0) / LEAF
    done = None
    level, schema = 0, every.schema
    while True:
        last = widest <= 1

        stage = durable(every.groupBy("source", "leaf").applyInArrow(_rounder(level, seed, last), schema), "rounded")
        whole = stage.where("p = 0")
        done = whole if done is None else done.unionAll(whole)
        if last:
            return done.select("doc_id", "source", "size", "h", "m", "c", "source_size", "target")
        every = stage.where("p > 0").withColumn("leaf", F.floor(F.col("leaf") / FAN_IN))
        widest, level = widest / FAN_IN, level + 1


def _words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words, repeats counted).

    See :func:`mix` for the rules; further columns are ignored, an empty table gives an empty one.
    """
    taken = mix(docs.select("doc_id", "source", _words(F.col("text")).alias("size"), F.xxhash64("text").alias("h")), **how)
    rows = F.explode(F.sequence(F.lit(1).cast("long"), F.col("m")))
    each = taken.select("doc_id", "size", "source_size", "target", "m", "c", rows.alias("i"))
    copies = F.floor(F.col("c") / F.col("m")) + (F.col("i") <= F.col("c") % F.col("m")).cast("long")
    return each.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"))


def repeat_documents(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, all columns kept, whatever their names.

    Rows that agree in doc_id, source and text share what is taken of them as evenly as whole copies go. Those that agree in
    all columns are counted first, so that only different ones meet in a window.
    """
    plain, names = positional(docs)
    of = dict(zip(docs.columns, names, strict=True))
    text = F.col(of["text"])
    sized = plain.select(*names, _words(text).alias("size"), F.xxhash64(text).alias("h"))
    taken = mix(sized.select(F.col(of["doc_id"]).alias("doc_id"), F.col(of["source"]).alias("source"), "size", "h"), **how)
    taken = durable(taken.select(*[F.col(c).alias(f"t_{c}") for c in ("doc_id", "source", "size", "h", "m", "c")]), "taken")
    key = F.col(of["doc_id"]).eqNullSafe(F.col("t_doc_id")) & F.col(of["source"]).eqNullSafe(F.col("t_source"))
    both = sized.join(taken, key & (F.col("size") == F.col("t_size")) & (F.col("h") == F.col("t_h")))
    out = both.where("t_m = 1").select(*names, F.col("t_c").alias("times"))
    if not taken.where("t_m > 1").isEmpty():
        shared = [F.col(c) for c in ("t_doc_id", "t_source", "t_size", "t_h")]
        alike = both.where("t_m > 1").groupBy(*names, *shared, "t_m", "t_c").agg(F.count("*").alias("n"))
        before = F.sum("n").over(Window.partitionBy(*shared).orderBy(*names)) - F.col("n")
        extra = F.greatest(F.least(F.col("before") + F.col("n"), F.col("t_c") % F.col("t_m")) - F.col("before"), F.lit(0))
        times = (F.floor(F.col("t_c") / F.col("t_m")) * F.col("n") + extra).cast("long")
        out = out.unionAll(alike.withColumn("before", before).select(*names, times.alias("times")))
    out = out.where("times > 0").select(*names, F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return out.select(*names).toDF(*docs.columns)
