"""Event counts, presence, sessions and the learning loop as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from memloom.operators.learning import insert_or_confirm


def read_events(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def counts_by_window(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events of each type by tumbling window; rows later than the watermark are left out and old state is dropped."""
    stamped = events.withColumn("_at", F.col("ts").cast("timestamp")).withWatermark("_at", late)
    return stamped.groupBy(F.window("_at", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def presence(events: DataFrame) -> DataFrame:
    """Each agent's last heartbeat; state is one row for each agent."""
    return events.groupBy("user_id").agg(F.max("ts").alias("last_seen"))


def sessions(events: DataFrame, gap: str = "12 hours", late: str = "1 hour") -> DataFrame:
    stamped = events.withColumn("_at", F.col("ts").cast("timestamp")).withWatermark("_at", late)
    return stamped.groupBy(F.session_window("_at", gap).alias("s"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("stop"), "n")


def learn(messages: DataFrame, checkpoint: str, load: Callable[[], DataFrame], save: Callable[[DataFrame, int], None], threshold: float = 0.75) -> StreamingQuery:
    """Insert or confirm each batch of facts (id, content) into a store. save gets the batch's number: a repeated batch
    writes the same version again, so the loop is idempotent."""

    def step(batch: DataFrame, number: int) -> None:
        save(insert_or_confirm(load(), batch, threshold), number)

    return messages.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
