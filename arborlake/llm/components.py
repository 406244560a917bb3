"""Connected components by alternating large-star and small-star steps, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from arborlake.runtime import durable


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a durable table, with a checksum taken while they are written."""
    seen = Observation()
    table = durable(edges.observe(seen, F.count("*").alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x")), "edges")
    return table, (seen.get["n"], seen.get["x"])


def connected_components(edges: DataFrame, left: str = "a", right: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root) for every node that an edge touches; root is the component's smallest node.

    Nodes may be of any orderable type. Edges with a null end and loops are ignored; repeated edges and
    either direction are the same edge; no edges give no rows. Each round shuffles only edges, keeps
    at most as many of them as it got, and is written to the shared folder. Stars are what a round leaves as they are,
    so the rounds end when the checksum of the edges stays; it is taken while they are written. A node with very many
    edges is a skewed join key of plain equi-joins, which adaptive execution splits.
    """
    a, b = F.col(left), F.col(right)
    e = edges.where(a.isNotNull() & b.isNotNull() & (a != b))
    e, before = _written(e.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())
    for _ in range(rounds):
        if not before[0]:
            break
        up = e.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
        both = up.unionAll(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        hops = large.join(lowest, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        e, now = _written(hops.unionAll(lowest.select("hi", F.col("m").alias("lo"))).distinct())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no convergence within {rounds} rounds")
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionAll(e.select("lo", "lo").distinct())
