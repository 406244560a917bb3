"""Counts and bytes by extension, size bucket and calendar bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlake.functions.calendar import Boundaries
from arborlake.functions.sizes import BUCKETS, bucket_label, size_bucket


def _sums() -> tuple[Column, Column]:
    return F.count("*").alias("count"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")



def by_extension(files: DataFrame) -> DataFrame:
    """extension, count, bytes, rank: most bytes first, then by name."""
    out = files.groupBy("extension").agg(*_sums())
    # one row per extension reaches the window, which only numbers them for display
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("bytes"), "extension")))


def _dense(sums: list[tuple[str, Column, Column]], files: DataFrame) -> DataFrame:
    """One row for each (label, count, bytes), zeros included, from one pass over ``files``."""
    rows = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(label).alias("bucket"), n.alias("count"), b.alias("bytes")) for i, (label, n, b) in enumerate(sums)])
    return files.agg(rows.alias("rows")).select(F.inline("rows"))


def _when(test: Column) -> tuple[Column, Column]:
    return F.count_if(test), F.coalesce(F.sum(F.when(test, F.col("size"))), F.lit(0)).cast("long")


def by_size_bucket(files: DataFrame) -> DataFrame:
    """ordinal, bucket, count, bytes: always all five buckets, smallest sizes first."""
    return _dense([(label, *_when(size_bucket(F.col("size")) == i)) for i, (_, label) in enumerate(BUCKETS)], files)


# Labels of the cumulative date buckets.
DATE_LABELS = ("today", "this week", "this month", "this year")


def _within(b: Boundaries) -> list[Column]:
    """Each bucket's test. Buckets are nested: the week counts only within the month, that within the year."""
    t = F.col("mtime_ms")
    starts = (b.today, max(b.week, b.month, b.year), max(b.month, b.year), b.year)
    return [(t < b.tomorrow) & (t >= max(s, b.year)) for s in starts]


def by_date(files: DataFrame, b: Boundaries) -> DataFrame:
    """ordinal, bucket, count, bytes: today, this week, month and year, cumulative and always all four.

    Rows dated after the day are in none of them.
    """
    return _dense([(label, *_when(test)) for label, test in zip(DATE_LABELS, _within(b), strict=True)], files)


def by_prior_year(files: DataFrame, b: Boundaries) -> DataFrame:
    """year, count, bytes of the years before, those with files only; the caller orders by year."""
    year = F.year(F.timestamp_millis("mtime_ms")).alias("year")
    return files.where(F.col("mtime_ms") < b.year).groupBy(year).agg(*_sums())


def date_table(files: DataFrame, b: Boundaries) -> DataFrame:
    """by_date followed by the prior years, latest first, in display order."""
    now = by_date(files, b)
    years = by_prior_year(files, b).select((F.lit(20_000) - F.col("year")).alias("ordinal"), F.col("year").cast("string").alias("bucket"), "count", "bytes")
    return now.unionByName(years).orderBy("ordinal")


def totals(files: DataFrame) -> DataFrame:
    """One row: count and bytes of all files, those dated in the future included."""
    return files.agg(*_sums())


def report_cube(files: DataFrame) -> DataFrame:
    """Extension and size-bucket tables and the total from a single scan, told apart by ``dimension``."""
    rows = files.select("extension", size_bucket(F.col("size")).alias("b"), "size")
    out = rows.groupingSets([[F.col("extension")], [F.col("b")], []], "extension", "b").agg(F.grouping_id().alias("g"), *_sums())
    dimension = F.when(F.col("g") == 1, "extension").when(F.col("g") == 2, "bucket").otherwise("total")
    key = F.when(F.col("g") == 1, F.col("extension")).when(F.col("g") == 2, bucket_label(F.col("b"))).otherwise("total")
    return out.select(dimension.alias("dimension"), key.alias("key"), "count", "bytes")
