"""Content-addressed WARC archive: each payload is stored once, under its SHA-256.

Two tables in one folder: ``payloads`` (digest, payload), bucketed by digest, and ``headers`` (the exact header block
of each record, with its digest), split by record type. A record is read back by joining both and is its
header block followed by the payload; the payload is digested again and compared. Payloads never
move: headers are bucketed alike. Only the payloads of hot digests (a thousand at most, each of over a thousandth of
all records, such as empty pages or a page that many others copy) are joined in parts by :func:`spread_join`.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.llm.text import utf8
from arborlake.runtime import HOT_KEYS, durable, shared_path, spread_join

_END = "\r\n"


@dataclass(frozen=True)
class Archive:
    """Where an archive lies; the tables are registered in the session that wrote or opened it."""

    folder: str
    payloads: str
    headers: str


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value. A line end would end the line, so within a value it is percent-encoded."""
    value = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(_END)), F.lit(""))


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))


def records(pages: DataFrame, least_bytes: int, date: str) -> DataFrame:
    """(page_id, type, digest, header) for every page; header is the record's exact header block."""
    payload = utf8(F.col("html"))
    rows = durable(pages.select("page_id", "url", F.sha2(payload, 256).alias("digest"), F.length(payload).cast("long").alias("n")), "digests")
    groups = rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("n").alias("bytes"), F.count("*").alias("k"))
    groups = durable(groups, "groups")
    first = groups.where((F.col("bytes") >= least_bytes) & (F.col("k") > 1)).select("digest", "first")
    rows = spread_join(rows, first, "digest", groups.select("digest", F.col("k").alias("n")), F.col("page_id"), "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    header = F.concat(
        F.lit(f"WARC/1.1{_END}"),
        F.when(again, f"WARC-Type: revisit{_END}").otherwise(f"WARC-Type: response{_END}"),
        _field("WARC-Record-ID", F.coalesce(_urn(F.col("page_id")), F.concat(F.lit("<urn:sha256:"), "digest", F.lit(">")))),
        _field("WARC-Target-URI", F.col("url")),
        F.lit(f"WARC-Date: {date}{_END}"),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        F.when(again, F.concat(_field("WARC-Refers-To", _urn(F.col("first"))), F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{_END}"))).otherwise(""),
        F.lit(f"Content-Type: text/html; charset=utf-8{_END}"),
        _field("Content-Length", F.when(again, F.lit(0)).otherwise(F.col("n"))),
        F.lit(_END),
    )
    return rows.select("page_id", F.when(again, "revisit").otherwise("response").alias("type"), "digest", header.cast("binary").alias("header"))


def write_archive(pages: DataFrame, least_bytes: int = 100, date: str = "2024-01-01T00:00:00Z", folder: str | None = None) -> Archive:
    """Archive every row of ``pages`` (page_id, url, html) and return where it lies.

    The payload is the html in UTF-8, empty for null. Of records with equal payloads of at least ``least_bytes``
    the one with the smallest page_id is a response and the others revisit it (rows that repeat that
    page_id are responses too; if all page_ids are null, all are); records with smaller payloads are all
    responses. Null urls leave their header line out; records with a null page_id are named by their digest. An empty table makes an
    empty archive; further columns are ignored.
    """
    spark = pages.sparkSession
    folder = folder or shared_path(spark, "warc")
    name = f"warc_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    payload = utf8(F.col("html"))
    store = pages.select(F.sha2(payload, 256).alias("digest"), payload.alias("payload")).groupBy("digest").agg(F.first("payload").alias("payload"))
    at = Archive(folder, f"{name}_payloads", f"{name}_headers")
    for table, frame, sub in ((at.payloads, store, "payloads"), (at.headers, records(pages, least_bytes, date), "headers")):
        to = frame.write.option("compression", "zstd").option("path", f"{folder}/{sub}").bucketBy(n, "digest").sortBy("digest")
        (to.partitionBy("type") if sub == "headers" else to).saveAsTable(table)
    return at


def read_archive(spark: SparkSession, at: Archive) -> DataFrame:
    """(type, header, payload) of every record, the payload in full for revisits too.

    Fails if a stored payload does not have its digest.
    """
    headers, payloads = spark.table(at.headers), spark.table(at.payloads)
    counts = durable(headers.groupBy("digest").agg(F.count("*").alias("n")), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = [r.digest for r in counts.where(F.col("n") > max(1, total // HOT_KEYS)).select("digest").collect()]  # HOT_KEYS at most
    cold = headers.where(~F.col("digest").isin(hot)).join(payloads.where(~F.col("digest").isin(hot)), "digest") if hot else headers.join(payloads, "digest")
    both = cold.select("type", "header", "digest", "payload")
    if hot:
        named = counts.where(F.col("digest").isin(hot))
        warm = spread_join(headers.where(F.col("digest").isin(hot)), payloads.where(F.col("digest").isin(hot)), "digest", named, F.col("header"))
        both = both.unionAll(warm.select("type", "header", "digest", "payload"))
    sound = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), "digest")).cast("binary"))
    return both.select("type", "header", sound.alias("payload"))


def _value(header: Column, name: str) -> Column:
    """A header field's value; null if the field is missing."""
    return F.nullif(F.regexp_extract(header, rf"\r\n{name}: ([^\r\n]*)", 1), F.lit(""))


def record_columns(read: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, parsed from records read back."""
    header = F.col("header").cast("string")
    page = lambda name: F.nullif(F.regexp_extract(header, rf"\r\n{name}: <urn:page:(-?\d+)>", 1), F.lit("")).cast("long")
    return read.select(
        page("WARC-Record-ID").alias("page_id"), F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"),
        _value(header, "WARC-Type").alias("record_type"), page("WARC-Refers-To").alias("refers_to"), _value(header, "WARC-Target-URI").alias("url"),
    )


def export_warc(read: DataFrame, folder: str, records_per_file: int = 2000) -> None:
    """Write records as plain WARC files: header block, content (none for revisits), two line ends."""
    block = F.concat("header", F.when(F.col("type") == "revisit", F.lit(b"")).otherwise(F.col("payload")))
    read.select(block.cast("string").alias("value")).write.option("lineSep", _END * 2).option("maxRecordsPerFile", records_per_file).text(folder)


def import_warc(spark: SparkSession, folder: str) -> DataFrame:
    """(header, content) of every record of the plain WARC files in a folder, cut by Content-Length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                data, at, out = data.as_py(), 0, []
                while at < len(data):
                    end = data.index(b"\r\n\r\n", at) + 4
                    size = next(int(x.split(b":")[1]) for x in data[at:end].split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    out.append((data[at:end], data[end : end + size]))
                    at = end + size + 4
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.binary()) for i in (0, 1)], ["header", "content"])

    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(run, "header binary, content binary")
