"""Shuffle files of finished steps are let go while a query still runs."""

import time

from pyspark.sql import functions as F

from memloom.llm.common import keep, release


def test_shuffle_files_go_between_steps(spark):
    files = lambda: sum(f.getName().startswith("shuffle_") for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()))
    release(spark)
    time.sleep(2)
    before = files()
    kept = keep(spark, spark.range(10_000).repartition(7, F.col("id")))
    assert files() > before
    release(spark)  # once
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.2)
    assert files() <= before and kept.count() == 10_000
