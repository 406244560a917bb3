"""Snapshots of folder sizes: a line ``# <instant>``, then ``bytes<TAB>count<TAB>folder`` lines."""

from __future__ import annotations

import os
from collections.abc import Iterable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_baseline(file: str, at: datetime, rows: Iterable[tuple[str, int, int]]) -> None:
    """Replace ``file`` by the (folder, count, bytes) rows, by way of a sibling, making its folder if needed."""
    os.makedirs(os.path.dirname(os.path.abspath(file)), exist_ok=True)
    with open(f"{file}.tmp", "w", encoding="utf-8") as out:
        out.write(f"# {at.astimezone(UTC).isoformat().replace('+00:00', 'Z')}\n")
        for folder, count, size in rows:
            if "\n" in folder or "\r" in folder:
                raise ValueError(f"a folder name with a line end cannot be stored: {folder!r}")
            out.write(f"{size}\t{count}\t{folder}\n")
    os.replace(f"{file}.tmp", file)


def save_baseline(folders: DataFrame, at: datetime, folder: str) -> None:
    """The same lines as a folder of text files, written by the tasks: for snapshots too large for the driver.

    Raises (within the job) if a folder name has a line end.
    """
    spark = folders.sparkSession
    line = F.concat_ws("\t", F.col("bytes").cast("string"), F.col("count").cast("string"), "folder")
    bad = F.raise_error(F.concat(F.lit("a folder name with a line end cannot be stored: "), "folder")).cast("string")
    lines = folders.select(F.when(F.col("folder").rlike("[\r\n]"), bad).otherwise(line).alias("value"))
    head = spark.createDataFrame([(f"# {at.astimezone(UTC).isoformat().replace('+00:00', 'Z')}",)], "value string")
    head.unionAll(lines).write.text(folder)


def read_baseline(spark: SparkSession, file: str) -> tuple[datetime, DataFrame]:
    """(instant, folder and bytes); of a repeated folder the last line counts. Raises ValueError if malformed."""
    lines = spark.read.text(file).select("value", F.monotonically_increasing_id().alias("at")).where("value <> ''")
    head = [r.value for r in lines.where(F.col("value").startswith("# ")).orderBy(F.desc("at")).limit(1).collect()]
    if not head:
        raise ValueError(f"{file} has no line with its instant")
    parts = F.split("value", "\t", 3)
    rows = lines.where(~F.col("value").startswith("# ")).select("at", "value", F.size(parts).alias("n"), F.get(parts, F.lit(2)).alias("folder"), F.get(parts, F.lit(0)).try_cast("long").alias("bytes"))
    bad = rows.where("n < 3 OR bytes IS NULL").limit(1).collect()
    if bad:
        raise ValueError(f"{file} has a malformed line: {bad[0].value!r}")
    last = F.row_number().over(Window.partitionBy("folder").orderBy(F.desc("at")))
    rows = rows.withColumn("last", last).where("last = 1").select("folder", "bytes")
    return datetime.fromisoformat(head[0][2:].strip().replace("Z", "+00:00")), rows
