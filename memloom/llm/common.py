"""Helpers that all operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space bytes, as the contracts name them: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\f\r"
WORD = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bits of the filter on wanted ids: 16 MiB at most.
FILTER_BITS = 1 << 27


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a folder of our own serves local
    runs; on a cluster each machine would write to its own disk there, so that is an error."""
    jsc = spark.sparkContext._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        set_to = spark.conf.get("spark.checkpoint.dir", None)
        if not set_to and not jsc.isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(set_to or tempfile.mkdtemp(prefix="memloom-"))
    return jsc.getCheckpointDir().get()


def keep(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage and survives the loss of executors."""
    path = f"{shared_dir(spark)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, df: DataFrame) -> None:
    """Delete what keep() wrote, once nothing reads it any more."""
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Shuffle files stay until the driver's garbage collector finds that nobody can read them, which a quiet heap puts off for
    long. After steps that shuffle texts, what they have written is let go before the next one writes as much."""
    for _ in range(2):  # what the first round lets go holds what the second one finds
        gc.collect()  # what Python holds of the JVM's objects
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def only_wanted(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose _id is among ids, and a few more, so that other texts aren't shuffled: a bitmap of hashed ids,
    16 bits for each and FILTER_BITS at most, goes to all tasks as words of 64 bits. Beyond that size it only filters less."""
    bits = min(FILTER_BITS, max(1 << 16, 1 << (16 * ids.count()).bit_length()))
    place = F.pmod(F.xxhash64("_id", F.lit("wanted")), F.lit(bits))
    marks = ids.select(F.shiftright(place, 6).alias("_at"), (place % 64).cast("int").alias("_bit"))
    words = marks.groupBy("_at").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_mask"))
    spread = docs.withColumn("_at", F.shiftright(place, 6)).withColumn("_bit", (place % 64).cast("int"))
    return spread.join(F.broadcast(words), "_at").where(F.expr("(_mask & shiftleft(1L, _bit)) <> 0")).select(*docs.columns)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def part_of(spark: SparkSession, rows: float, rows_per_task: float) -> int:
    """Partitions for so many rows: grows with the data, never below the session's shuffle width."""
    return max(shuffle_width(spark), int(rows // rows_per_task) + 1)
