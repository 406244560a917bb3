"""Filters over file relations, with tallies of what they leave out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Observation

from arborlake.functions.paths import in_excluded_folder


def _is_file(files: DataFrame) -> Column:
    return F.col("entry_kind") == "file" if "entry_kind" in files.columns else F.lit(True)


def _extension_ok(extensions: frozenset[str] | None) -> Column:
    return F.lit(True) if extensions is None else F.col("extension").isin(*sorted(extensions))


def at_least(files: DataFrame, min_size: int) -> DataFrame:
    """Files of that size or larger."""
    return files.where(F.col("size") >= min_size)


def with_extensions(files: DataFrame, extensions: frozenset[str] | None) -> DataFrame:
    """Files with one of the extensions; all if None."""
    return files.where(_extension_ok(extensions))


def outside_folders(files: DataFrame, names: list[str]) -> DataFrame:
    """Files with none of the folder names on their path."""
    return files.where(~in_excluded_folder(F.col("path"), names))


def _tallies(files: DataFrame, min_size: int, extensions: frozenset[str] | None) -> list[Column]:
    """A row that fails both tests is charged to size alone."""
    file = _is_file(files)
    small = file & (F.col("size") < min_size)
    other = file & (F.col("size") >= min_size) & ~_extension_ok(extensions)
    kind = F.col("entry_kind") if "entry_kind" in files.columns else F.lit("file")
    amount = lambda test: F.coalesce(F.sum(F.when(test, F.col("size"))), F.lit(0)).cast("long")
    return [
        F.count_if(small).alias("size_skipped_n"), amount(small).alias("size_skipped_bytes"),
        F.count_if(other).alias("ext_skipped_n"), amount(other).alias("ext_skipped_bytes"),
        F.count_if(kind == "inaccessible_dir").alias("inaccessible_dirs"), F.count_if(kind == "inaccessible_file").alias("inaccessible_files"),
    ]


def filter_tally(files: DataFrame, min_size: int = 0, extensions: frozenset[str] | None = None) -> DataFrame:
    """One row of the tallies, as a query of its own."""
    return files.agg(*_tallies(files, min_size, extensions))


def filtered(files: DataFrame, min_size: int = 0, extensions: frozenset[str] | None = None) -> tuple[DataFrame, Observation]:
    """The surviving files, and the tallies as an observation that the first action over them fills."""
    seen = Observation("filters")
    out = files.observe(seen, *_tallies(files, min_size, extensions))
    return out.where(_is_file(files) & (F.col("size") >= min_size) & _extension_ok(extensions)), seen
