"""Byte-identical files by size, then a digest of the head, then one of the whole content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.operators.listing import numbered
from arborlake.runtime import durable, spread_join

#: Bytes of the first digest.
HEAD_BYTES = 4096


def same_size(files: DataFrame) -> DataFrame:
    """Non-empty files that share their size with another: counts are joined back, so no group is gathered."""
    sizes = files.where("size > 0").groupBy("size").agg(F.count("*").alias("n")).where("n >= 2")
    return files.join(sizes.select("size"), "size", "left_semi")


def head_digest(content: Column) -> Column:
    return F.sha2(F.substring(content, 1, HEAD_BYTES), 256)


def content_digests(files: DataFrame) -> DataFrame:
    """A table that holds its content, with ``head`` and ``digest`` instead: made where rows are read, so that no content is
    ever shuffled."""
    head = head_digest(F.col("content"))
    return files.withColumn("head", head).withColumn("digest", F.when(F.col("size") <= HEAD_BYTES, F.col("head")).otherwise(F.sha2("content", 256))).drop("content")


def repeated(files: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys are shared by another row."""
    often = files.groupBy(*keys).agg(F.count("*").alias("n")).where("n >= 2").drop("n")
    return files.join(often, list(keys), "left_semi")


def one_name_per_inode(files: DataFrame) -> DataFrame:
    """Of the hard links of one content only the smallest path; files without a known inode stand for themselves."""
    inode = F.coalesce(F.concat(F.lit("inode:"), F.col("dev").cast("string"), F.lit(":"), F.col("ino").cast("string")), F.concat(F.lit("path:"), F.col("path")))
    return files.groupBy("size", "digest", inode.alias("inode")).agg(F.min("path").alias("path")).drop("inode")


def groups(files: DataFrame) -> DataFrame:
    """size, digest, n, waste, keeper: contents that two or more paths have; the smallest path is kept.

    files: size, digest, path (one row per path to count). One row per group leaves the aggregation; no
    list of paths is gathered.
    """
    out = files.groupBy("size", "digest").agg(F.count("*").alias("n"), F.min("path").alias("keeper")).where("n >= 2")
    return out.withColumn("waste", (F.col("n") - 1) * F.col("size"))


def members(files: DataFrame) -> DataFrame:
    """size, digest, path, position (1: the keeper), n, waste: the paths of every group in order.

    Groups of one are left out first. The places of a group's paths follow from one order of all members, so the
    paths of a large group are dealt to many tasks.
    """
    found = durable(groups(files).select("size", "digest", "n", "waste"), "groups").withColumn("__key", _key())
    counts = found.select("__key", "n")
    of = found.select("__key", "n", "waste")
    some = spread_join(files.withColumn("__key", _key()), of, "__key", counts, F.col("path"))
    some = durable(numbered(some, F.col("size"), F.col("digest"), F.col("path"), name="__rank"), "members")
    first = some.groupBy("__key").agg(F.min("__rank").alias("__first"))
    placed = spread_join(some, first, "__key", counts, F.col("path"))
    at = (F.col("__rank") - F.col("__first") + 1).cast("int")
    return placed.select("size", "digest", "path", at.alias("position"), "n", "waste")


def _key() -> Column:
    return F.concat(F.col("size").cast("string"), F.lit(":"), F.col("digest"))


def redundant(files: DataFrame) -> DataFrame:
    """size, digest, path of every member but the keepers."""
    keep = groups(files).select("size", "digest", "keeper")
    return files.join(keep, ["size", "digest"]).where(F.col("path") != F.col("keeper")).select("size", "digest", "path")


def summary(groups_: DataFrame) -> DataFrame:
    """One row: groups, redundant files and bytes."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return groups_.agg(F.count("*").alias("groups"), total(F.col("n") - 1).alias("redundant_files"), total("waste").alias("redundant_bytes"))
