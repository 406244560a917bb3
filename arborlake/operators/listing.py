"""Ordered listings of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlake.functions.sizes import human_bytes_column, timestamp_text
from arborlake.runtime import durable, small_side

# The column behind each sort key, whether it ascends by default, and the order of display.
KEYS = {
    "path": ("path", True, ("path", "modified", "size")),
    "date": ("mtime_ms", False, ("modified", "size", "path")),
    "size": ("size", False, ("size", "path", "modified")),
}


def order(key: str, ascending: bool | None = None) -> list[Column]:
    """Sort columns; ties go by path, ascending."""
    column, natural, _ = KEYS[key]
    first = F.col(column).asc() if (natural if ascending is None else ascending) else F.col(column).desc()
    return [first] if column == "path" else [first, F.col("path").asc()]


def listing(files: DataFrame, key: str = "path", ascending: bool | None = None) -> DataFrame:
    """Files in order (a range-partitioned sort)."""
    return files.orderBy(*order(key, ascending))


def display(files: DataFrame, key: str, *more: str) -> DataFrame:
    """The listing's text columns, the sorted one first, and ``more``."""
    columns = {"path": F.col("path"), "modified": timestamp_text(F.col("mtime_ms")), "size": human_bytes_column(F.col("size"))}
    return files.select(*[columns[c].alias(c) for c in KEYS[key][2]], *more)


def numbered(rows: DataFrame, *by: Column, name: str = "rank") -> DataFrame:
    """``rows`` with their place in the order ``by``, from 1 on.

    Rows are range-partitioned and sorted once and written with their place within the partition; the rows of all earlier
    partitions are added to it. So no task orders everything, and nothing is sorted or shuffled again.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, *by).sortWithinPartitions(*by)
    placed = durable(placed.withColumn("__id", F.monotonically_increasing_id()), "ranked")  # partition << 33 | place within it
    part = F.shiftright("__id", 33)
    sizes = placed.groupBy(part.alias("__p")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per partition
    offsets = small_side(durable(sizes.select("__p", before.alias("__before")), "offsets"))
    out = placed.join(offsets, part == F.col("__p"))
    place = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__before") + 1
    return out.withColumn(name, place).drop("__id", "__p", "__before")


def ranked(files: DataFrame, key: str = "path", ascending: bool | None = None) -> DataFrame:
    """Files with their place in the order as ``rank``."""
    return numbered(files, *order(key, ascending))
