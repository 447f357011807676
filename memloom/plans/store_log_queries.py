"""Queries over array files read by ranges, versioned backups and the change feed."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from memloom.plans.catalog import ORACLE_SQL, query
from memloom.plans.views import EPISODES, FACTS, activity, episodes, facts, table, with_views
from memloom.session import shared_dir
from memloom.sources.exports import stream_chat
from memloom.sources.json_array import write_json_array
from memloom.sources.versions import Backups, ChangeFeed


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("s11_streamed_export", ORACLE_SQL["s10_export_round_trip"])
def s11(spark, sf):
    """Conversations written as array files and read back by byte ranges."""
    said = table(spark, sf, "conversations").where("text is not null and trim(text) <> ''").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    path = _folder(spark, "export")
    write_json_array(said.select(F.col("conv_id").cast("string").alias("uuid"), F.transform("m", lambda m: F.struct(m["role"].alias("sender"), m["text"].alias("text"))).alias("chat_messages")), path)
    back = stream_chat(spark, path)
    return back.select(F.col("id").cast("long").alias("id"), F.size("messages").cast("long").alias("n_messages"), F.array_join(F.transform("messages", lambda m: m["content"]), "|").alias("said"))


@query("s28_backups", with_views("""SELECT version, t, n, confidence FROM (
  SELECT 1 AS version, 'facts' AS t, count(*) AS n, round(sum(confidence), 6)::DOUBLE AS confidence FROM facts UNION ALL SELECT 2, 'facts', count(*), round(sum(least(1.0, confidence + 0.1)), 6)::DOUBLE FROM facts WHERE NOT is_superseded
  UNION ALL SELECT 3, 'facts', count(*), round(sum(confidence), 6)::DOUBLE FROM facts UNION ALL SELECT v, 'episodes', count(*), NULL FROM episodes, (VALUES (1), (2), (3)) x(v) GROUP BY v)""", FACTS, EPISODES))
def s28(spark, sf):
    """Two backups of facts and episodes, the second after a change, then the first restored as the third version."""
    backups, f, e = Backups(spark, _folder(spark, "backups")), facts(spark, sf), episodes(spark, sf)
    backups.create({"facts": f, "episodes": e}, "first")
    backups.create({"facts": f.where("not is_superseded").withColumn("confidence", F.least(F.lit(1.0), F.col("confidence") + 0.1)), "episodes": e}, "second")
    backups.versions.restore(1)
    out = None
    for listed in backups.list():
        tables = backups.restore(listed["version"])
        counted = tables["facts"].agg(F.lit("facts").alias("t"), F.count("*").alias("n"), F.round(F.sum("confidence"), 6).alias("confidence"))
        counted = counted.unionByName(tables["episodes"].agg(F.lit("episodes").alias("t"), F.count("*").alias("n"), F.lit(None).cast("double").alias("confidence")))
        counted = counted.select(F.lit(listed["version"]).alias("version"), "t", "n", "confidence")
        out = counted if out is None else out.unionByName(counted)
    return out


@query("e07_snapshot_then_changes", "SELECT event_type, count(*) FILTER (event_id % 4 < 2) AS in_snapshot, count(*) FILTER (event_id % 4 >= 2) AS pushed, count(DISTINCT event_id) AS distinct_events FROM events GROUP BY event_type")
def e07(spark, sf):
    """Events published in four commits; a consumer that joins after two gets a snapshot and then each later change once."""
    feed, events = ChangeFeed(spark, _folder(spark, "feed")), activity(spark, sf).select("event_id", "event_type")
    for k in range(2):
        feed.publish(events.where(F.col("event_id") % 4 == k))
    at, snapshot = feed.snapshot()
    seen = snapshot.withColumn("pushed", F.lit(0))
    for k in range(2, 4):
        feed.publish(events.where(F.col("event_id") % 4 == k))
        at, more = feed.after(at)
        seen = seen.unionByName(more.withColumn("pushed", F.lit(1)))
    return seen.groupBy("event_type").agg(F.sum(1 - F.col("pushed")).alias("in_snapshot"), F.sum("pushed").alias("pushed"), F.count_distinct("event_id").alias("distinct_events"))
