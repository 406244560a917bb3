from pyspark.sql import functions as F

from arborlake import runtime



def test_broadcasts_are_measured(spark):
    small = runtime.durable(spark.range(100))
    assert runtime.fits_broadcast(small) and not runtime.fits_broadcast(small, 99) and runtime.fits_broadcast(small, 100)
    wide = runtime.durable(spark.range(2000).select("id", F.expr("repeat(cast(rand(1) as string), 1000)").alias("x")))
    estimate = int(str(wide._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert runtime.fits_broadcast(wide) == (estimate <= runtime.BROADCAST_BYTES)
    assert not runtime.fits_broadcast(spark.range(10_000_000))


def test_durable_tables_are_in_the_shared_folder(spark):
    df = runtime.durable(spark.range(5).withColumn("x", F.lit("a")), "probe")
    assert df.count() == 5 and all(runtime.shared_root(spark).split(":")[-1] in f for f in df.inputFiles())
    assert runtime.durable(spark.range(0)).count() == 0
