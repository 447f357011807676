"""What operators need of a session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the session's spark.checkpoint.dir. Where it is unset, a local master gets a folder of its own; on a cluster each
    machine would write to its own disk there, so that is an error."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        set_to = spark.conf.get("spark.checkpoint.dir", None)
        if not set_to and not context._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(set_to or tempfile.mkdtemp(prefix="memloom-"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def keep(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage and survives the loss of executors."""
    path = f"{shared_dir(spark)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
