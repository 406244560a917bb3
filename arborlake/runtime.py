"""Session and storage helpers shared by every operator."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and estimated bytes up to which a table may be broadcast; above either the same join runs with a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master without that setting (tests, a laptop)
    gets a temporary folder of this process, set as the checkpoint folder; elsewhere its absence is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
        root = root.rsplit("/", 1)[0] if root else None
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="arborlake-")
        spark.sparkContext.setCheckpointDir(root)
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_root(spark)}/arborlake/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and return the written table.

    This cuts the lineage and survives the loss of any executor; nothing is kept in executor memory.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` (cheap to read, best a durable table) is small: first by the optimizer's estimate, an upper one
    as it takes filters to keep everything, then by counting its rows."""
    plan = df._jdf.queryExecution().optimizedPlan()
    return int(str(plan.stats().sizeInBytes())) <= BROADCAST_BYTES and df.count() <= rows


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its measured size allows, else unchanged (a shuffled join)."""
    return F.broadcast(df) if fits_broadcast(df, rows) else df


#: Keys that :func:`spread_join` treats apart, at most: those with over this part of all rows.
HOT_KEYS = 1000


def spread_join(left: DataFrame, right: DataFrame, key: str, counts: DataFrame, by: Column, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` (a row per key) on ``key``, no task getting all rows of a hot key.

    counts: (key, n), the number of left rows of each key, a durable table. Keys with over a thousandth of all rows
    are HOT_KEYS at most, which bounds what is broadcast: each with the number of parts it is dealt in. Left rows
    choose a part by the hash of ``by``; right rows are repeated for each part.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    share = max(1, -(-total // HOT_KEYS))
    hot = counts.where(F.col("n") > share).select(F.col(key).alias("__hot"), F.ceil(F.col("n") / share).cast("long").alias("__parts"))
    if hot.isEmpty():
        return left.join(right, key, how)
    hot = F.broadcast(hot)
    dealt = left.join(hot, F.col(key) == F.col("__hot"), "left").withColumn("__part", F.coalesce(F.pmod(F.xxhash64(by), F.col("__parts")), F.lit(0)))
    copies = F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("__parts"), F.lit(1)) - 1)
    spread = right.join(hot, F.col(key) == F.col("__hot"), "left").withColumn("__part", F.explode(copies))
    joined = dealt.drop("__hot", "__parts").join(spread.drop("__hot", "__parts"), [key, "__part"], how)
    return joined.drop("__part")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch on its way to a Python worker, unless the session's own setting says otherwise.
ARROW_BYTES = 8 << 20
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once an application, and bound what they get at once."""
    context, batch = spark.sparkContext, "spark.sql.execution.arrow.maxBytesPerBatch"
    if context.getConf().get(batch) is None:
        spark.conf.set(batch, ARROW_BYTES)
    if context.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="arborlake-code-")  # the driver serves it from there
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    root = Path(__file__).resolve().parent.parent
    context.addPyFile(shutil.make_archive(f"{folder}/arborlake", "zip", root, "arborlake"))
    _shipped.add(context.applicationId)
