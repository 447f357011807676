"""Counts, histograms, trends and reports over facts and episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memloom.functions.fixed import VALENCES
from memloom.functions.text import terms, week_key


def share(cond: Column) -> Column:
    return F.avg(cond.cast("double"))


def buckets(value: Column, edges: list[tuple[str, float]], last: str) -> Column:
    """The name of the first edge that the value reaches, from the highest down."""
    out = F.lit(last)
    for name, edge in reversed(edges):
        out = F.when(value >= edge, name).otherwise(out)
    return out


def emotion_levels(spark, episodes: DataFrame) -> DataFrame:
    """Every valence level with its number of episodes and its percentage, zero where there are none."""
    levels = spark.createDataFrame(list(VALENCES.items()), "valence int, level string")
    counts = episodes.groupBy(F.col("valence").cast("int").alias("valence")).agg(F.count("*").alias("n"))
    total = episodes.agg(F.count("*").alias("total"))
    out = levels.join(counts, "valence", "left").join(F.broadcast(total))
    n = F.coalesce("n", F.lit(0))
    return out.select("level", n.alias("n"), F.when(F.col("total") > 0, n * 100.0 / F.col("total")).otherwise(0.0).alias("percent"))


def half_trend(events: DataFrame, order: list[str], hit: Column) -> DataFrame:
    """Hits in the earlier and the later half by time: rising, falling or stable (a fifth more or less).

    The halves are told apart by a rank that comes from counts of rows by day and within the day, so no task orders all rows.
    """
    days = events.withColumn("_day", F.to_date(order[0]))
    by_day = days.groupBy("_day").agg(F.count("*").alias("_n"))
    before = by_day.select("_day", (F.sum("_n").over(Window.orderBy("_day")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_total"))
    placed = days.join(before, "_day").withColumn("_place", F.col("_before") + F.row_number().over(Window.partitionBy("_day").orderBy(*order)))
    early = F.col("_place") <= F.floor(F.col("_total") / 2)
    sums = placed.agg(F.count_if(early & hit).alias("early"), F.count_if(~early & hit).alias("late"))
    return sums.withColumn("trend", F.when(F.col("late") > 1.2 * F.col("early"), "increasing").when(F.col("late") < 0.8 * F.col("early"), "decreasing").otherwise("stable"))


def topic_report(episodes: DataFrame, top: int = 5) -> DataFrame:
    """For each topic its episodes, first and last time, mean importance and most frequent terms."""
    stats = episodes.groupBy("topic").agg(F.count("*").alias("n"), F.min("started_at").alias("first_seen"), F.max("started_at").alias("last_seen"), F.avg("importance").alias("importance"))
    counts = episodes.select("topic", F.explode(terms(F.col("summary"))).alias("term")).groupBy("topic", "term").agg(F.count("*").alias("c"))
    ranked = counts.withColumn("_r", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("c"), "term"))).where(F.col("_r") <= top)
    words = ranked.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("_r", "term"))).alias("_w")).select("topic", F.array_join(F.transform("_w", lambda x: x["term"]), ",").alias("keywords"))
    return stats.join(words, "topic", "left")


def weekly(rows: DataFrame, ts: str) -> DataFrame:
    return rows.groupBy(week_key(F.col(ts)).alias("week")).agg(F.count("*").alias("n"))


def idf(rows: DataFrame, text: str) -> DataFrame:
    """Document frequency and inverse document frequency of every term."""
    n = rows.agg(F.count("*").alias("_n"))
    df = rows.select(F.explode(F.array_distinct(terms(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(n)).select("term", "df", (F.log((F.col("_n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
