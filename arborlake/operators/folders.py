"""Recursive folder sizes, pass-through folders, and growth against a snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.functions.paths import folders_up_to, parent_of
from arborlake.runtime import durable, small_side


def direct(files: DataFrame) -> DataFrame:
    """folder, count, bytes of the files directly in each folder; paths without a folder are left out."""
    folder = parent_of(F.col("path"))
    return files.select(folder.alias("folder"), "size").where("folder IS NOT NULL").groupBy("folder").agg(F.count("*").alias("count"), F.sum("size").alias("bytes"))


def roll_up(tally: DataFrame, root: str) -> DataFrame:
    """folder, count, bytes of all files beneath each folder from ``root`` down; the root is always there.

    tally: from :func:`direct`, so what is spread to ancestors are folders, not files. The root's rows are
    pre-aggregated within each task like all others.
    """
    spread = tally.select(F.explode(folders_up_to(F.col("folder"), root)).alias("folder"), "count", "bytes")
    zero = tally.sparkSession.range(1).select(F.lit(root).alias("folder"), F.lit(0).cast("long").alias("count"), F.lit(0).cast("long").alias("bytes"))
    return spread.unionByName(zero).groupBy("folder").agg(F.sum("count").alias("count"), F.sum("bytes").alias("bytes"))


def without_pass_through(rolled: DataFrame, root: str) -> DataFrame:
    """Without folders that hold exactly what their parent holds, so that of a chain only the top stays."""
    up = rolled.select(F.col("folder").alias("__up"), F.col("count").alias("__n"), F.col("bytes").alias("__b"))
    same = (parent_of(F.col("folder")) == F.col("__up")) & (F.col("count") == F.col("__n")) & (F.col("bytes") == F.col("__b")) & (F.col("folder") != root)
    return rolled.join(up, same, "left_anti")


def report_rows(files: DataFrame, root: str, min_bytes: int = 0) -> DataFrame:
    """The folders to show: rolled up, collapsed, of ``min_bytes`` at least (the root always)."""
    rows = without_pass_through(roll_up(direct(files), root), root)
    return rows.where((F.col("folder") == root) | (F.col("bytes") >= min_bytes))


def growth(baseline: DataFrame, current: DataFrame, threshold: float) -> DataFrame:
    """folder, was, now, pct of folders that grew by more than ``threshold`` percent since the baseline.

    Folders without a baseline, or with one of no bytes, have no percentage.
    """
    was = durable(baseline.where("bytes > 0").select("folder", F.col("bytes").alias("was")), "baseline")
    both = current.select("folder", F.col("bytes").alias("now")).join(small_side(was), "folder")
    pct = (F.col("now") - F.col("was")) * F.lit(100.0) / F.col("was")
    return both.withColumn("pct", pct).where(F.col("pct") > float(threshold)).select("folder", "was", "now", "pct")


def appeared(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """folder, count, bytes of folders without a baseline, or with one of no bytes."""
    known = durable(baseline.where("bytes <> 0").select("folder"), "baseline")
    return current.join(small_side(known), "folder", "left_anti")
