"""Digests of files' contents, read where the tasks run."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.operators.duplicates import HEAD_BYTES, repeated, same_size
from arborlake.runtime import durable

_CHUNK = 1 << 20


def file_digest(path: str, most: int | None = None) -> str | None:
    """SHA-256 of a file or of its first ``most`` bytes, in chunks; None if it cannot be read."""
    digest = hashlib.sha256()
    try:
        with open(path, "rb") as f:
            while most is None or most > 0:
                data = f.read(_CHUNK if most is None else min(_CHUNK, most))
                if not data:
                    break
                digest.update(data)
                most = None if most is None else most - len(data)
    except OSError:
        return None
    return digest.hexdigest()


def with_digest(files: DataFrame, name: str, most: int | None = None) -> DataFrame:
    """``files`` with the digest of each file at ``path`` (null: unreadable), written once so that none is read twice."""
    schema = files.schema.add(name, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([file_digest(p, most) for p in b.column("path").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, found], [*b.schema.names, name])

    return durable(files.repartition(files.sparkSession.sparkContext.defaultParallelism * 4).mapInArrow(run, schema), name)


def staged_digests(files: DataFrame) -> tuple[DataFrame, int]:
    """(files with ``digest`` that share size and digest with another, number of unreadable files).

    Only files that share their size are opened, and only those that also share their head are read in full.
    """
    heads = with_digest(same_size(files), "head", HEAD_BYTES)
    close = durable(repeated(heads.where("head IS NOT NULL"), "size", "head"), "close")
    short = close.where(F.col("size") <= HEAD_BYTES).withColumn("digest", F.col("head"))
    full = with_digest(close.where(F.col("size") > HEAD_BYTES), "digest")
    unread = heads.where("head IS NULL").count() + full.where("digest IS NULL").count()
    return repeated(short.unionByName(full.where("digest IS NOT NULL")), "size", "digest"), unread
