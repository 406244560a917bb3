"""The file relation: any DataFrame with path, size and mtime_ms, and adapters that make other tables one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.functions.paths import base_name, extension_of

REQUIRED = {"path": "string", "size": "bigint", "mtime_ms": "bigint"}


def check_relation(files: DataFrame, *columns: str) -> DataFrame:
    """``files`` itself if it has the columns with their types, else a TypeError that names what is wrong."""
    have = dict(files.dtypes)
    wrong = [f"{c} is {have.get(c, 'missing')}, not {REQUIRED[c]}" for c in columns or REQUIRED if have.get(c) != REQUIRED[c]]
    if wrong:
        raise TypeError("not a file relation: " + "; ".join(wrong))
    return files


def with_extension(files: DataFrame) -> DataFrame:
    return files.withColumn("extension", extension_of(base_name(F.col("path"))))


def _bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def of_documents(docs: DataFrame) -> DataFrame:
    """Each text as a file ``/corpus/<source>/<lang>/<doc_id>.txt``; content is its UTF-8 bytes."""
    path = F.concat(F.lit("/corpus/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select(path.alias("path"), _bytes(F.col("text")).alias("size"), F.lit(0).cast("long").alias("mtime_ms"), F.col("text").cast("binary").alias("content"), "doc_id")


def of_pages(pages: DataFrame) -> DataFrame:
    """Each page as a file at its url's host and path, without query, fragment and a final slash."""
    path = F.regexp_replace(F.regexp_extract("url", r"^[^:]*:/(/[^?#]*)", 1), r"/\z", "")
    return pages.select(path.alias("path"), _bytes(F.col("html")).alias("size"), F.lit(0).cast("long").alias("mtime_ms"))


def of_events(events: DataFrame) -> DataFrame:
    """Each event as a file ``/events/<type>/<user>/<event>.json`` of the size of its properties."""
    path = F.concat(F.lit("/events/"), "event_type", F.lit("/"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_id").cast("string"), F.lit(".json"))
    return events.select(path.alias("path"), _bytes(F.col("props")).alias("size"), F.unix_millis(F.col("ts").cast("timestamp")).alias("mtime_ms"))


def of_orders(orders: DataFrame) -> DataFrame:
    """Each order as a file dated by the order, as large as its price in cents."""
    path = F.concat(F.lit("/orders/"), F.col("o_orderkey").cast("string"))
    return orders.select(path.alias("path"), F.round(F.col("o_totalprice") * 100).cast("long").alias("size"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("mtime_ms"))
