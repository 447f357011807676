"""Queries over stores: scans, filters, state changes, counts, sets and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from memloom.functions import scoring as sc
from memloom.functions.fixed import FACT_TYPES
from memloom.functions.text import tokens_by_length, week_key, word_count
from memloom.operators import analytics, stores, windows
from memloom.plans.catalog import query
from memloom.plans.views import EPISODES, FACTS, FEEDBACK, as_of, episodes, facts, feedback, table, with_views

FACT_COLS = ("id", "fact_type", "confidence", "importance")
F_SQL = "id, fact_type, confidence, importance"


def r6(c):
    return F.round(c, 6)


@query("s01_point_lookup", with_views(f"SELECT {F_SQL} FROM facts WHERE id = 3001", FACTS))
def s01(spark, sf):
    return stores.lookup(facts(spark, sf), "id", 3001).select(*FACT_COLS)


@query("s02_page_episodes", with_views("SELECT id, topic, started_at FROM episodes ORDER BY started_at DESC, id LIMIT 25 OFFSET 10", EPISODES))
def s02(spark, sf):
    return stores.page(episodes(spark, sf), [F.desc("started_at"), F.asc("id")], 25, 10).select("id", "topic", "started_at")


@query("s03_page_facts_by_type", with_views(f"SELECT {F_SQL} FROM facts WHERE fact_type = 'project' ORDER BY importance DESC, confidence DESC, id LIMIT 50", FACTS))
def s03(spark, sf):
    return stores.page(facts(spark, sf).where("fact_type = 'project'"), [F.desc("importance"), F.desc("confidence"), F.asc("id")], 50).select(*FACT_COLS)


@query("s04_work_queue", "SELECT conv_id, count(*) AS n_messages FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'assistant') < 2 ORDER BY conv_id")
def s04(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.count_if(F.col("role") == "assistant").alias("_done"))
    return c.where("_done < 2").select("conv_id", "n_messages")


@query("s05_upsert_facts", with_views("SELECT id, content, CASE WHEN importance >= 0.9 THEN 1.0::DOUBLE ELSE confidence END AS confidence FROM facts UNION ALL SELECT DISTINCT -1 - conv_id, 'new', 0.5::DOUBLE FROM conversations", FACTS))
def s05(spark, sf):
    store = facts(spark, sf).select("id", "content", "confidence")
    changed = facts(spark, sf).where("importance >= 0.9").select("id", "content", F.lit(1.0).alias("confidence"))
    new = table(spark, sf, "conversations").select((-1 - F.col("conv_id")).alias("id")).distinct().select("id", F.lit("new").alias("content"), F.lit(0.5).alias("confidence"))
    return stores.upsert(store, changed.unionByName(new), "id")


@query("s07_latest_version", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n = 1")
def s07(spark, sf):
    return stores.latest(table(spark, sf, "conversations"), "conv_id", [F.desc("turn")]).select("conv_id", "turn", "role")


@query("s08_hard_delete", with_views(f"SELECT {F_SQL} FROM facts WHERE NOT is_superseded", FACTS))
def s08(spark, sf):
    f = facts(spark, sf)
    return stores.delete(f, f.where("is_superseded"), "id").select(*FACT_COLS)


@query("s09_soft_delete", with_views("SELECT id, is_superseded OR confidence < 0.4 AS is_superseded, CASE WHEN confidence < 0.4 THEN 0.0::DOUBLE ELSE confidence END AS confidence FROM facts", FACTS))
def s09(spark, sf):
    f = facts(spark, sf)
    return stores.soft_delete(f, f.where("confidence < 0.4"), "id", {"is_superseded": F.lit(True), "confidence": F.lit(0.0)}).select("id", "is_superseded", "confidence")


@query("s21_bulk_validation", with_views("""SELECT id, list_filter([CASE WHEN length(trim(content)) = 0 THEN 'content is empty' END, CASE WHEN fact_type = 'world' THEN 'unknown type' END,
  CASE WHEN confidence * 1.1 > 1 THEN 'confidence out of range' END], lambda e: e IS NOT NULL) AS errors FROM facts""", FACTS))
def s21(spark, sf):
    rows = facts(spark, sf).withColumns({"confidence": F.col("confidence") * 1.1, "fact_type": F.when(F.col("fact_type") == "world", "planet").otherwise(F.col("fact_type"))})
    return stores.validated(rows, FACT_TYPES).select("id", "errors")


@query("s26_export_facts", with_views("SELECT id, content, fact_type, category AS topic, array_to_string(tags, ',') AS tags FROM facts", FACTS))
def s26(spark, sf):
    return facts(spark, sf).select("id", "content", "fact_type", F.col("category").alias("topic"), F.array_join("tags", ",").alias("tags"))


@query("s27_restore_skips_known", with_views("SELECT id, content FROM facts", FACTS))
def s27(spark, sf):
    """An export restored over a store that holds a part of it: known ids are skipped."""
    f = facts(spark, sf).select("id", "content")
    known = f.where("id >= 50000")
    return known.unionByName(stores.delete(f, known, "id"))


@query("s29_resume_import", "SELECT conv_id, count(*) AS n FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system') GROUP BY conv_id")
def s29(spark, sf):
    c = table(spark, sf, "conversations")
    return stores.delete(c, c.where("role = 'system'").select("conv_id").distinct(), "conv_id").groupBy("conv_id").agg(F.count("*").alias("n"))


@query("s30_undo_batch", with_views("SELECT fact_type AS batch, count(*) AS facts, count(*) FILTER (fact_type <> 'general') AS kept FROM facts GROUP BY fact_type", FACTS))
def s30(spark, sf):
    f = facts(spark, sf)
    undone = stores.soft_delete(f.withColumn("gone", F.lit(False)), f.where("fact_type = 'general'"), "id", {"gone": F.lit(True)})
    return undone.groupBy(F.col("fact_type").alias("batch")).agg(F.count("*").alias("facts"), F.count_if(~F.col("gone")).alias("kept"))


@query("s31_review_queue", with_views("SELECT id, CASE WHEN confidence >= 0.7 THEN 'approved' WHEN confidence >= 0.4 THEN 'pending' ELSE 'rejected' END AS status, CASE WHEN confidence >= 0.7 THEN greatest(0.5::DOUBLE, confidence) ELSE confidence END AS confidence FROM facts", FACTS))
def s31(spark, sf):
    status = F.when(F.col("confidence") >= 0.7, "approved").when(F.col("confidence") >= 0.4, "pending").otherwise("rejected")
    f = facts(spark, sf).withColumn("status", status)
    return f.select("id", "status", F.when(F.col("status") == "approved", F.greatest(F.lit(0.5), "confidence")).otherwise(F.col("confidence")).alias("confidence"))


@query("s32_evaluation_export", with_views("SELECT id, content, fact_type, confidence, importance FROM facts WHERE contains(lower(content), 'tion') ORDER BY importance DESC, id LIMIT 50", FACTS))
def s32(spark, sf):
    return stores.page(facts(spark, sf).where(F.contains(F.lower("content"), F.lit("tion"))), [F.desc("importance"), F.asc("id")], 50).select("id", "content", "fact_type", "confidence", "importance")


@query("s34_additive_migration", with_views("SELECT id, fact_type, NULL::VARCHAR AS note FROM facts UNION ALL SELECT id, NULL, topic FROM episodes", FACTS, EPISODES))
def s34(spark, sf):
    return facts(spark, sf).select("id", "fact_type").unionByName(episodes(spark, sf).select("id", F.col("topic").alias("note")), allowMissingColumns=True)


@query("s36_clear", with_views("SELECT id, fact_type FROM facts WHERE false", FACTS))
def s36(spark, sf):
    return facts(spark, sf).select("id", "fact_type").limit(0)


@query("s37_archive", with_views("SELECT id::VARCHAR AS archive_id, 'fact' AS entry_type, 'old' AS reason FROM facts WHERE first_learned < TIMESTAMP '2023-11-01' AND importance < 0.5", FACTS))
def s37(spark, sf):
    old = facts(spark, sf).where((F.col("first_learned") < F.lit("2023-11-01").cast("timestamp_ntz")) & (F.col("importance") < 0.5))
    return stores.archived(old, "id", "fact", "old").drop("payload")


@query("s38_restore_archive", with_views("SELECT id, content, confidence FROM facts WHERE importance < 0.5", FACTS))
def s38(spark, sf):
    return stores.restored(stores.archived(facts(spark, sf).where("importance < 0.5"), "id", "fact", "old"), "id long, content string, confidence double")


@query("p01_time_range", with_views("SELECT id, started_at FROM episodes WHERE started_at BETWEEN TIMESTAMP '2023-12-01' AND TIMESTAMP '2024-01-31' ORDER BY started_at DESC, id LIMIT 50", EPISODES))
def p01(spark, sf):
    inside = F.col("started_at").between(F.lit("2023-12-01").cast("timestamp_ntz"), F.lit("2024-01-31").cast("timestamp_ntz"))
    return stores.page(episodes(spark, sf).where(inside), [F.desc("started_at"), F.asc("id")], 50).select("id", "started_at")


@query("p02_thresholds", with_views(f"SELECT {F_SQL} FROM facts WHERE confidence >= 0.9 AND NOT is_superseded ORDER BY confidence DESC, id LIMIT 50", FACTS))
def p02(spark, sf):
    return stores.page(facts(spark, sf).where("confidence >= 0.9 and not is_superseded"), [F.desc("confidence"), F.asc("id")], 50).select(*FACT_COLS)


@query("p03_by_valence", with_views("SELECT id, importance, started_at FROM episodes WHERE valence = 1 ORDER BY importance DESC, started_at DESC, id LIMIT 20", EPISODES))
def p03(spark, sf):
    return stores.page(episodes(spark, sf).where("valence = 1"), [F.desc("importance"), F.desc("started_at"), F.asc("id")], 20).select("id", "importance", "started_at")


@query("p04_type_then_superseded", with_views("SELECT id, importance FROM (SELECT * FROM facts WHERE fact_type = 'world' ORDER BY importance DESC, confidence DESC, id LIMIT 50) WHERE NOT is_superseded", FACTS))
def p04(spark, sf):
    """In the documented order: the limit comes before the superseded rows are dropped."""
    return stores.page(facts(spark, sf).where("fact_type = 'world'"), [F.desc("importance"), F.desc("confidence"), F.asc("id")], 50).where("not is_superseded").select("id", "importance")


@query("p05_like_fallback", with_views("SELECT id FROM facts WHERE contains(lower(content), 'en the') ORDER BY importance DESC, id LIMIT 100", FACTS))
def p05(spark, sf):
    return stores.page(facts(spark, sf).where(F.col("content").ilike(stores.like_pattern("en the"))), [F.desc("importance"), F.asc("id")], 100).select("id")


@query("p07_dynamic_predicate", "SELECT event_id, user_id, ts FROM events WHERE user_id = 7 AND ts > TIMESTAMP '2024-01-10' ORDER BY ts DESC, event_id LIMIT 50")
def p07(spark, sf):
    agent, since = 7, "2024-01-10"
    where = stores.every(F.col("user_id") == agent if agent is not None else None, F.col("ts") > F.lit(since).cast("timestamp_ntz") if since else None)
    return stores.page(table(spark, sf, "events").where(where), [F.desc("ts"), F.asc("event_id")], 50).select("event_id", "user_id", "ts")


@query("p09_addressee_or_all", "SELECT event_id, event_type, user_id FROM events WHERE (user_id = 3 OR event_type = 'signup') AND value > 10")
def p09(spark, sf):
    return table(spark, sf, "events").where("(user_id = 3 or event_type = 'signup') and value > 10").select("event_id", "event_type", "user_id")


@query("p10_tag_membership", with_views("SELECT id, list_has_any(tags, ['even', 'fifth']) AS any_tag, list_has_all(tags, ['even', 'third']) AS all_tags FROM facts", FACTS))
def p10(spark, sf):
    ask, need = F.array(F.lit("even"), F.lit("fifth")), F.array(F.lit("even"), F.lit("third"))
    return facts(spark, sf).select("id", F.arrays_overlap("tags", ask).alias("any_tag"), (F.size(F.array_except(need, "tags")) == 0).alias("all_tags"))


@query("p11_archive_rule", with_views("SELECT id FROM facts WHERE (first_learned IS NULL OR first_learned < TIMESTAMP '2023-11-03') AND importance < 0.4 AND confirmation_count <= 3", FACTS))
def p11(spark, sf):
    old = F.col("first_learned").isNull() | (F.col("first_learned") < F.lit("2023-11-03").cast("timestamp_ntz"))
    return facts(spark, sf).where(old & (F.col("importance") < 0.4) & (F.col("confirmation_count") <= 3)).select("id")


@query("p12_parse_json_columns", "SELECT event_id, coalesce((props::JSON ->> 'k')::BIGINT, 0) AS k FROM events")
def p12(spark, sf):
    return table(spark, sf, "events").select("event_id", F.coalesce(F.from_json("props", "k long")["k"], F.lit(0)).alias("k"))


@query("p14_feedback_delta", with_views("""SELECT f.id, round(greatest(0, least(1, confidence + 0.05::DOUBLE * coalesce(d, 0))), 6)::DOUBLE AS confidence FROM facts f
  LEFT JOIN (SELECT fact_id, sum(CASE WHEN is_positive THEN 1 ELSE -1 END) AS d FROM feedback GROUP BY fact_id) x ON f.id = x.fact_id""", FACTS, FEEDBACK))
def p14(spark, sf):
    delta = feedback(spark, sf).groupBy(F.col("fact_id").alias("id")).agg(F.sum(F.when(F.col("is_positive"), 1).otherwise(-1)).alias("_d"))
    return facts(spark, sf).join(delta, "id", "left").select("id", r6(sc.clamp(F.col("confidence") + 0.05 * F.coalesce("_d", F.lit(0)))).alias("confidence"))


@query("p15_access_reinforcement", with_views("""SELECT f.id, access_count + coalesce(n, 0) AS access_count, round(least(1, importance + 0.02::DOUBLE * coalesce(n, 0)), 6)::DOUBLE AS importance, last AS last_accessed
  FROM facts f LEFT JOIN (SELECT fact_id, count(*) AS n, max(ts) AS last FROM feedback GROUP BY fact_id) x ON f.id = x.fact_id""", FACTS, FEEDBACK))
def p15(spark, sf):
    out = stores.reinforced(facts(spark, sf), feedback(spark, sf).withColumnRenamed("fact_id", "id"), "id")
    return out.select("id", "access_count", r6(F.col("importance")).alias("importance"), "last_accessed")


@query("p18_tag_edits", with_views("SELECT id, array_to_string(list_sort(list_filter(list_distinct(list_concat(tags, ['new'])), lambda t: t <> 'third')), ',') AS tags FROM facts", FACTS))
def p18(spark, sf):
    added = F.array_remove(F.array_union("tags", F.array(F.lower(F.trim(F.lit(" New "))))), "third")
    return facts(spark, sf).select("id", F.array_join(F.array_sort(added), ",").alias("tags"))


@query("p20_recall_by_emotion", with_views("SELECT id, valence FROM (SELECT * FROM episodes ORDER BY started_at DESC, id LIMIT 30) WHERE valence > 0", EPISODES))
def p20(spark, sf):
    return stores.page(episodes(spark, sf), [F.desc("started_at"), F.asc("id")], 30).where("valence > 0").select("id", "valence")


@query("a01_table_counts", with_views("SELECT 'facts' AS name, count(*) AS n FROM facts UNION ALL SELECT 'episodes', count(*) FROM episodes UNION ALL SELECT 'feedback', count(*) FROM feedback", FACTS, EPISODES, FEEDBACK))
def a01(spark, sf):
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in (("facts", facts(spark, sf)), ("episodes", episodes(spark, sf)), ("feedback", feedback(spark, sf)))]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query("a02_feedback_counts", with_views("SELECT fact_id, count(*) FILTER (is_positive) AS positive, count(*) FILTER (NOT is_positive) AS negative FROM feedback GROUP BY fact_id", FEEDBACK))
def a02(spark, sf):
    return feedback(spark, sf).groupBy("fact_id").agg(F.count_if("is_positive").alias("positive"), F.count_if(~F.col("is_positive")).alias("negative"))


@query("a05_access_stats", with_views("SELECT sum(access_count)::BIGINT AS accesses, count(*) FILTER (last_confirmed > TIMESTAMP '2024-01-10') AS recent, round(avg(access_count), 6) AS mean_accesses FROM facts", FACTS))
def a05(spark, sf):
    return facts(spark, sf).agg(F.sum("access_count").alias("accesses"), F.count_if(F.col("last_confirmed") > F.lit("2024-01-10").cast("timestamp_ntz")).alias("recent"), r6(F.avg("access_count")).alias("mean_accesses"))


@query("a06_type_and_confidence_histogram", with_views("SELECT fact_type, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM facts GROUP BY ALL", FACTS))
def a06(spark, sf):
    return facts(spark, sf).groupBy("fact_type", analytics.buckets(F.col("confidence"), [("high", 0.8), ("medium", 0.5)], "low").alias("band")).agg(F.count("*").alias("n"))


@query("a08_facts_by_day", with_views("SELECT strftime(first_learned, '%Y-%m-%d') AS day, count(*) AS n, array_to_string(list(id ORDER BY id), ',') AS ids FROM facts GROUP BY 1", FACTS))
def a08(spark, sf):
    g = facts(spark, sf).groupBy(F.date_format("first_learned", "yyyy-MM-dd").alias("day"))
    return g.agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("ids"))


TERMS_SQL = """(SELECT topic, term, count(*) AS c FROM (SELECT topic, unnest(list_filter(regexp_extract_all(lower(summary), '[\\p{L}\\p{N}_]+'), lambda w: length(w) >= 2 AND w NOT IN (SELECT unnest(stop) FROM stops))) AS term FROM episodes, stops) GROUP BY ALL)"""


@query("a10_topic_diversity", with_views("SELECT round(least(1.0, count(DISTINCT topic) / (count(*) / 5.0)), 6)::DOUBLE AS diversity FROM episodes", EPISODES))
def a10(spark, sf):
    return episodes(spark, sf).agg(r6(F.least(F.lit(1.0), F.count_distinct("topic") / (F.count("*") / 5.0))).alias("diversity"))


@query("a11_emotion_distribution", with_views("""SELECT level, coalesce(n, 0) AS n, round(coalesce(n, 0) * 100.0::DOUBLE / (SELECT count(*) FROM episodes), 6) AS percent
  FROM (VALUES (-2, 'very_negative'), (-1, 'negative'), (0, 'neutral'), (1, 'positive'), (2, 'very_positive')) l(v, level) LEFT JOIN (SELECT valence, count(*) AS n FROM episodes GROUP BY valence) e ON e.valence = l.v""", EPISODES))
def a11(spark, sf):
    return analytics.emotion_levels(spark, episodes(spark, sf)).withColumn("percent", r6(F.col("percent")))


@query("a12_emotion_trend", with_views("""SELECT early, late, CASE WHEN late > 1.2 * early THEN 'increasing' WHEN late < 0.8 * early THEN 'decreasing' ELSE 'stable' END AS trend FROM (
  SELECT count(*) FILTER (p <= floor(t / 2) AND valence > 0) AS early, count(*) FILTER (p > floor(t / 2) AND valence > 0) AS late FROM (SELECT *, row_number() OVER (ORDER BY started_at, id) AS p, count(*) OVER () AS t FROM episodes))""", EPISODES))
def a12(spark, sf):
    return analytics.half_trend(episodes(spark, sf), ["started_at", "id"], F.col("valence") > 0)


@query("a13_emotional_balance", with_views("SELECT round(avg(valence) / 2, 6) AS balance FROM episodes", EPISODES))
def a13(spark, sf):
    return episodes(spark, sf).agg(r6(F.avg("valence") / 2).alias("balance"))


@query("a14_weekly_counts", with_views("SELECT strftime(started_at, '%Y-W%W') AS week, count(*) AS n FROM episodes GROUP BY 1", EPISODES))
def a14(spark, sf):
    return analytics.weekly(episodes(spark, sf), "started_at")


@query("a17_top_lists", with_views("SELECT 'accessed' AS list, id FROM (SELECT id FROM episodes ORDER BY access_count DESC, id LIMIT 10) UNION ALL SELECT 'important', id FROM (SELECT id FROM episodes ORDER BY importance DESC, id LIMIT 10)", EPISODES))
def a17(spark, sf):
    e = episodes(spark, sf)
    top = lambda c, name: stores.page(e, [F.desc(c), F.asc("id")], 10).select(F.lit(name).alias("list"), "id")
    return top("access_count", "accessed").unionAll(top("importance", "important"))


@query("a18_tag_counts", with_views("SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM facts UNION ALL SELECT topic FROM episodes) GROUP BY tag", FACTS, EPISODES))
def a18(spark, sf):
    tags = facts(spark, sf).select(F.explode("tags").alias("tag")).unionAll(episodes(spark, sf).select("topic"))
    return tags.groupBy("tag").agg(F.count("*").alias("n"))


@query("a21_mood_baseline", with_views("SELECT round(avg(valence / 2.0::DOUBLE), 6) AS mean, round(greatest(0.1, stddev_pop(valence / 2.0::DOUBLE)), 6)::DOUBLE AS spread, round(avg((valence > 0)::INT), 6) AS positive_ratio FROM episodes WHERE started_at >= TIMESTAMP '2024-01-02'", EPISODES))
def a21(spark, sf):
    v = F.col("valence") / 2.0
    recent = episodes(spark, sf).where(F.col("started_at") >= F.lit("2024-01-02").cast("timestamp_ntz"))
    return recent.agg(r6(F.avg(v)).alias("mean"), r6(F.greatest(F.lit(0.1), F.stddev_pop(v))).alias("spread"), r6(analytics.share(F.col("valence") > 0)).alias("positive_ratio"))


@query("a22_emotional_patterns", with_views("SELECT valence, count(*) AS n, round(avg(importance), 6) AS intensity, count(*) FILTER (hour(started_at) < 6) AS night, count(*) FILTER (hour(started_at) BETWEEN 6 AND 11) AS morning, count(*) FILTER (hour(started_at) BETWEEN 12 AND 17) AS afternoon, count(*) FILTER (hour(started_at) >= 18) AS evening FROM episodes GROUP BY valence", EPISODES))
def a22(spark, sf):
    h = F.hour("started_at")
    return episodes(spark, sf).groupBy("valence").agg(
        F.count("*").alias("n"), r6(F.avg("importance")).alias("intensity"), F.count_if(h < 6).alias("night"), F.count_if(h.between(6, 11)).alias("morning"), F.count_if(h.between(12, 17)).alias("afternoon"), F.count_if(h >= 18).alias("evening"))


@query("a27_request_metrics", "SELECT event_type AS source, count(*) AS requests, round(avg(value), 6) AS mean_latency, round(max(value), 6) AS max_latency, round(avg((value > 20)::INT), 6) AS slow_ratio FROM events GROUP BY event_type")
def a27(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("source")).agg(F.count("*").alias("requests"), r6(F.avg(v)).alias("mean_latency"), r6(F.max(v)).alias("max_latency"), r6(analytics.share(v > 20)).alias("slow_ratio"))


@query("a28_event_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def a28(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("a30_fact_summary", with_views("SELECT fact_type, place, id FROM (SELECT fact_type, id, row_number() OVER (PARTITION BY fact_type ORDER BY importance DESC, id) AS place FROM facts) WHERE place <= 20", FACTS))
def a30(spark, sf):
    return windows.top_per(facts(spark, sf), ["fact_type"], [F.desc("importance"), F.asc("id")], 20).select("fact_type", F.col("place").cast("long").alias("place"), "id")


@query("w02_prefix_budget", with_views("""SELECT fact_type, id, used FROM (SELECT fact_type, id, sum(len(list_filter(string_split_regex(content, '\\s+'), lambda w: w <> ''))) OVER (PARTITION BY fact_type ORDER BY importance DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS used FROM facts) WHERE used <= 200""", FACTS))
def w02(spark, sf):
    return windows.prefix_budget(facts(spark, sf), ["fact_type"], [F.desc("importance"), F.asc("id")], word_count(F.col("content")), 200).select("fact_type", "id", "used")


@query("w04_gap_sessions", "SELECT user_id, session, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT *, CASE WHEN date_diff('second', lag(ts) OVER w, ts) <= 43200 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY user_id, session")
def w04(spark, sf):
    e = table(spark, sf, "events").withColumn("_second", F.date_trunc("SECOND", "ts"))
    out = windows.sessions(e, ["user_id"], "_second", [F.col("ts"), F.col("event_id")], 43_200)
    return out.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("w05_timeline", with_views("SELECT strftime(started_at, '%Y-%m') AS month, strftime(started_at, '%Y-W%W') AS week, count(*) AS n, array_to_string(list(id ORDER BY started_at, id), ',') AS ids FROM episodes GROUP BY 1, 2", EPISODES))
def w05(spark, sf):
    g = episodes(spark, sf).groupBy(F.date_format("started_at", "yyyy-MM").alias("month"), week_key(F.col("started_at")).alias("week"))
    return g.agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("started_at", "id"))), lambda x: x["id"].cast("string")), ",").alias("ids"))


@query("w09_neighbour_links", "SELECT conv_id, turn, lag(turn) OVER w AS previous, lead(turn) OVER w AS following FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def w09(spark, sf):
    from pyspark.sql.window import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.lag("turn").over(w).alias("previous"), F.lead("turn").over(w).alias("following"))


@query("w10_first_occurrence", with_views("SELECT id, category FROM (SELECT id, category, row_number() OVER (PARTITION BY lower(trim(category)), fact_type ORDER BY importance DESC, id) AS n FROM facts) WHERE n = 1", FACTS))
def w10(spark, sf):
    return windows.first_by(facts(spark, sf), [F.lower(F.trim("category")), F.col("fact_type")], [F.desc("importance"), F.asc("id")]).select("id", "category")


@query("w11_anniversaries", with_views("SELECT id, started_at, 2025 - year(started_at) AS years FROM episodes WHERE year(started_at) < 2025 AND abs(date_diff('day', make_date(2025, month(started_at), day(started_at)), DATE '2025-01-20')) <= 3", EPISODES))
def w11(spark, sf):
    out = windows.anniversaries(episodes(spark, sf), "started_at", F.lit("2025-01-20").cast("date"))
    return out.select("id", "started_at", F.col("years").cast("long").alias("years"))


@query("t06_most_accessed", with_views("SELECT id, access_count FROM facts ORDER BY access_count DESC, id LIMIT 10", FACTS))
def t06(spark, sf):
    return stores.page(facts(spark, sf), [F.desc("access_count"), F.asc("id")], 10).select("id", "access_count")


@query("t13_working_set", with_views("SELECT id FROM facts ORDER BY round(greatest(0, least(1, importance * pow(0.5, date_diff('second', last_confirmed, TIMESTAMP '2024-02-01') / 3600.0 * 0.1 / 24) + 0.1 * ln(1 + access_count))), 9) DESC, id LIMIT 7", FACTS))
def t13(spark, sf):
    strength = sc.base_strength(sc.hours_between(F.col("last_confirmed"), as_of()), F.col("importance"), F.col("access_count"))
    return stores.page(facts(spark, sf), [F.desc(F.round(strength, 9)), F.asc("id")], 7).select("id")


@query("u01_branches_first_wins", with_views("""SELECT id, branch FROM (SELECT id, branch, row_number() OVER (PARTITION BY id ORDER BY branch) AS n FROM (
  SELECT id, 1 AS branch FROM episodes WHERE started_at >= TIMESTAMP '2024-01-25' UNION ALL SELECT id, 2 FROM episodes WHERE valence = 2 UNION ALL SELECT id, 3 FROM episodes WHERE importance >= 0.8)) WHERE n = 1""", EPISODES))
def u01(spark, sf):
    e = episodes(spark, sf)
    parts = [e.where(F.col("started_at") >= F.lit("2024-01-25").cast("timestamp_ntz")), e.where("valence = 2"), e.where("importance >= 0.8")]
    tagged = [p.select("id", F.lit(i + 1).alias("branch")) for i, p in enumerate(parts)]
    return windows.first_by(tagged[0].unionAll(tagged[1]).unionAll(tagged[2]), [F.col("id")], [F.col("branch")])


@query("u06_tagged_union", with_views("SELECT 'fact' AS kind, id, importance FROM facts UNION ALL SELECT 'episode', id, importance FROM episodes", FACTS, EPISODES))
def u06(spark, sf):
    return facts(spark, sf).select(F.lit("fact").alias("kind"), "id", "importance").unionByName(episodes(spark, sf).select(F.lit("episode").alias("kind"), "id", "importance"))


@query("e02_event_feed", "SELECT event_id, event_type, ts FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 50 OFFSET 5")
def e02(spark, sf):
    return stores.page(table(spark, sf, "events").where("event_type = 'error'"), [F.desc("ts"), F.asc("event_id")], 50, 5).select("event_id", "event_type", "ts")


@query("e03_heartbeats", "SELECT user_id, max(ts) AS last_seen, arg_max(event_type, ts) FILTER (event_type <> 'view') AS task FROM events GROUP BY user_id")
def e03(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("user_id").agg(F.max("ts").alias("last_seen"), F.max_by("event_type", F.when(F.col("event_type") != "view", F.col("ts"))).alias("task"))


@query("e04_active_agents", "SELECT user_id, max(ts) AS last_seen FROM events GROUP BY user_id HAVING max(ts) >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def e04(spark, sf):
    e = table(spark, sf, "events")
    last = e.groupBy("user_id").agg(F.max("ts").alias("last_seen"))
    return last.join(F.broadcast(e.agg(F.max("ts").alias("_now"))), F.col("last_seen") >= F.col("_now") - F.expr("INTERVAL 1 DAY")).drop("_now")


@query("e05_unread_notes", "SELECT event_id, user_id FROM events e WHERE event_type = 'signup' AND NOT EXISTS (SELECT 1 FROM events r WHERE r.event_type = 'view' AND r.user_id = e.user_id AND r.ts > e.ts)")
def e05(spark, sf):
    """A note is read once its addressee has looked at any later time: the last look of each is all that is joined."""
    e = table(spark, sf, "events")
    looked = e.where("event_type = 'view'").groupBy("user_id").agg(F.max("ts").alias("_last"))
    notes = e.where("event_type = 'signup'").join(looked, "user_id", "left")
    return notes.where(F.col("_last").isNull() | (F.col("_last") <= F.col("ts"))).select("event_id", "user_id")


@query("e08_split_every_20", "SELECT user_id, part, count(*) AS n, min(event_id) AS first_event FROM (SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 20 AS part FROM events) GROUP BY user_id, part")
def e08(spark, sf):
    from pyspark.sql.window import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf, "events").withColumn("part", F.floor((n - 1) / 20)).groupBy("user_id", "part").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("x26_token_estimates", with_views("SELECT id, length(content) // 4 AS by_length, length(content) // 4 + 1 AS counter FROM facts", FACTS))
def x26(spark, sf):
    n = tokens_by_length(F.col("content"))
    return facts(spark, sf).select("id", n.alias("by_length"), (n + 1).alias("counter"))
