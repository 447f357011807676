"""Queries that put operators together: reports, feeds, access, expansion."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memloom.functions import scoring as sc
from memloom.functions.sentiment import with_topic
from memloom.operators import graph, learning, stores, windows
from memloom.plans.catalog import query
from memloom.plans.indexes import text_index
from memloom.plans.search_queries import BM25
from memloom.plans.views import EPISODES, FACTS, FEEDBACK, LINKS, as_of, episodes, facts, feedback, links, table, with_views


def r6(c):
    return F.round(c, 6)


@query("j01_text_join", with_views("SELECT id, fact_type, round(score, 6)::DOUBLE AS score FROM facts JOIN scored USING (id)", FACTS, BM25.replace("{prefixes}", "('esta'), ('der')")))
def j01(spark, sf):
    hits = text_index(spark, sf).bm25(["esta", "der"])
    return facts(spark, sf).join(hits, "id").select("id", "fact_type", r6(F.col("score")).alias("score"))


@query("j17_topic_nodes", with_views("SELECT id, topic, dense_rank() OVER (ORDER BY topic) AS node FROM episodes", EPISODES))
def j17(spark, sf):
    """Topics are numbered among themselves, a few rows, and joined back."""
    topics = episodes(spark, sf).select("topic").distinct().withColumn("node", F.row_number().over(Window.orderBy("topic")).cast("long"))
    return episodes(spark, sf).join(topics, "topic").select("id", "topic", "node")


@query("a15_health_bands", with_views("""SELECT count(*) FILTER (s >= 0.7) AS strong, count(*) FILTER (s >= 0.3 AND s < 0.7) AS fair, count(*) FILTER (s < 0.3) AS weak, round(avg(s), 6)::DOUBLE AS mean FROM (
  SELECT greatest(0, least(1, importance * pow(0.5, date_diff('second', started_at, TIMESTAMP '2024-02-01') / 3600.0 * 0.1 / 24) + 0.1 * ln(1 + access_count))) AS s FROM episodes)""", EPISODES))
def a15(spark, sf):
    s = F.col("s")
    strength = sc.base_strength(sc.hours_between(F.col("started_at"), as_of()), F.col("importance"), F.col("access_count"))
    return episodes(spark, sf).select(strength.alias("s")).agg(F.count_if(s >= 0.7).alias("strong"), F.count_if((s >= 0.3) & (s < 0.7)).alias("fair"), F.count_if(s < 0.3).alias("weak"), r6(F.avg(s)).alias("mean"))


@query("a16_quick_report", with_views("SELECT (SELECT count(*) FROM facts) AS facts, (SELECT count(*) FROM episodes) AS episodes, (SELECT count(DISTINCT topic) FROM episodes) AS topics, (SELECT round(avg(valence) / 2, 6) FROM episodes) AS balance", FACTS, EPISODES))
def a16(spark, sf):
    e = episodes(spark, sf).agg(F.count("*").alias("episodes"), F.count_distinct("topic").alias("topics"), r6(F.avg("valence") / 2).alias("balance"))
    return facts(spark, sf).agg(F.count("*").alias("facts")).join(F.broadcast(e))


@query("a23_emotional_history", with_views("SELECT strftime(started_at, '%Y-%m') AS month, count(*) AS n, count(*) FILTER (valence > 0) AS positive, count(*) FILTER (valence < 0) AS negative FROM episodes GROUP BY 1", EPISODES))
def a23(spark, sf):
    return episodes(spark, sf).groupBy(F.date_format("started_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.count_if(F.col("valence") > 0).alias("positive"), F.count_if(F.col("valence") < 0).alias("negative"))


@query("a25_graph_stats", with_views("SELECT 'about' AS kind, count(*) AS n FROM episodes UNION ALL SELECT 'source_of', count(*) FROM facts WHERE source_episode IN (SELECT id FROM episodes) UNION ALL SELECT kind, count(*) FROM links GROUP BY kind", FACTS, EPISODES, LINKS))
def a25(spark, sf):
    return graph.property_graph(episodes(spark, sf), facts(spark, sf), links(spark, sf))[1].groupBy("kind").agg(F.count("*").alias("n"))


@query("a26_fact_type_counts", with_views("SELECT fact_type, count(*) AS n FROM facts GROUP BY fact_type", FACTS))
def a26(spark, sf):
    return facts(spark, sf).groupBy("fact_type").agg(F.count("*").alias("n"))


@query("w03_halves_by_topic", with_views("SELECT topic, count(*) FILTER (p <= floor(t / 2)) AS early, count(*) FILTER (p > floor(t / 2)) AS late FROM (SELECT topic, row_number() OVER (PARTITION BY topic ORDER BY started_at, id) AS p, count(*) OVER (PARTITION BY topic) AS t FROM episodes) GROUP BY topic", EPISODES))
def w03(spark, sf):
    w = Window.partitionBy("topic")
    early = F.row_number().over(w.orderBy("started_at", "id")) <= F.floor(F.count("*").over(w) / 2)
    return episodes(spark, sf).select("topic", early.alias("_e")).groupBy("topic").agg(F.count_if("_e").alias("early"), F.count_if(~F.col("_e")).alias("late"))


@query("w07_normalised_relevance", with_views("SELECT id, round(score / (SELECT max(score) FROM scored), 6)::DOUBLE AS relevance FROM scored", FACTS, BM25.replace("{prefixes}", "('esta'), ('der')")))
def w07(spark, sf):
    hits = text_index(spark, sf).bm25(["esta", "der"])
    return hits.join(F.broadcast(hits.agg(F.max("score").alias("_m")))).select("id", r6(F.col("score") / F.col("_m")).alias("relevance"))


@query("u02_link_ends", with_views("SELECT node, count(*) AS n FROM (SELECT source AS node FROM links UNION ALL SELECT target FROM links) GROUP BY node", LINKS))
def u02(spark, sf):
    ends = links(spark, sf).select(F.col("source").alias("node")).unionAll(links(spark, sf).select("target"))
    return ends.groupBy("node").agg(F.count("*").alias("n"))


@query("q06_episode_recall", with_views("SELECT e.id, round(greatest(0, least(1, importance * pow(0.5, date_diff('second', started_at, TIMESTAMP '2024-02-01') / 3600.0 / (168.0 * (1 + importance * 2) * (1 + 0.5 * ln(1 + access_count)))) + 0.02)), 6)::DOUBLE AS freshness FROM episodes e WHERE contains(lower(summary), 'en')", EPISODES))
def q06(spark, sf):
    fresh = sc.adaptive_strength(sc.hours_between(F.col("started_at"), as_of()), F.col("importance"), F.col("access_count"), F.lit(0.0), F.lit(0))
    return episodes(spark, sf).where(F.lower("summary").like("%en%")).select("id", r6(fresh).alias("freshness"))


@query("x20_fiction_filter", with_views("SELECT id FROM facts WHERE NOT list_has_any(string_split_regex(lower(content), '\\s+'), ['the', 'dragon', 'novel'])", FACTS))
def x20(spark, sf):
    return facts(spark, sf).where(~F.arrays_overlap(F.split(F.lower("content"), r"\s+"), F.array(*map(F.lit, ("the", "dragon", "novel"))))).select("id")


@query("x27_message_tokens", "SELECT conv_id, sum(length(text) // 4 + 1 + 4)::BIGINT AS tokens FROM conversations GROUP BY conv_id")
def x27(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.sum(F.floor(F.length("text") / 4) + 5).alias("tokens"))


@query("e01_event_vocabulary", "SELECT event_type, event_type IN ('click', 'view', 'error', 'purchase') AS known, count(*) AS n FROM events GROUP BY event_type")
def e01(spark, sf):
    known = F.col("event_type").isin("click", "view", "error", "purchase")
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n")).withColumn("known", known)


@query("r03_texts_by_category")
def r03(spark, sf):
    return with_topic(facts(spark, sf).select("id", "content"), "content").groupBy("category").agg(F.count("*").alias("n"))


@query("r08_recently_accessed", with_views("SELECT id, last_confirmed FROM facts WHERE last_confirmed >= TIMESTAMP '2024-01-05' ORDER BY last_confirmed DESC, id LIMIT 20", FACTS))
def r08(spark, sf):
    recent = facts(spark, sf).where(F.col("last_confirmed") >= F.lit("2024-01-05").cast("timestamp_ntz"))
    return stores.page(recent, [F.desc("last_confirmed"), F.asc("id")], 20).select("id", "last_confirmed")


@query("r10_feedback_delete", with_views("SELECT fact_id, count(*) AS n FROM feedback WHERE fact_id NOT IN (SELECT id FROM facts WHERE is_superseded) GROUP BY fact_id", FACTS, FEEDBACK))
def r10(spark, sf):
    gone = facts(spark, sf).where("is_superseded").select(F.col("id").alias("fact_id"))
    return stores.delete(feedback(spark, sf), gone, "fact_id").groupBy("fact_id").agg(F.count("*").alias("n"))


@query("r11_links_without_a_node", with_views("SELECT source, target, kind FROM links WHERE NOT (source = 12 OR target = 12)", LINKS))
def r11(spark, sf):
    return links(spark, sf).where("not (source = 12 or target = 12)").select("source", "target", "kind")


@query("r12_merged_facts", with_views("SELECT source_episode, fact_type, max(confidence) AS confidence, count(*) AS merged, min(id) AS id FROM facts GROUP BY ALL", FACTS))
def r12(spark, sf):
    return facts(spark, sf).groupBy("source_episode", "fact_type").agg(F.max("confidence").alias("confidence"), F.count("*").alias("merged"), F.min("id").alias("id"))


@query("r16_rounded_report", with_views("SELECT topic, n, share FROM (SELECT topic, count(*) AS n, round(count(*) * 1.0::DOUBLE / (SELECT count(*) FROM episodes), 2) AS share FROM episodes GROUP BY topic) ORDER BY n DESC, topic LIMIT 5", EPISODES))
def r16(spark, sf):
    e = episodes(spark, sf)
    out = e.groupBy("topic").agg(F.count("*").alias("n")).join(F.broadcast(e.agg(F.count("*").alias("_t")))).withColumn("share", F.round(F.col("n") / F.col("_t"), 2))
    return stores.page(out, [F.desc("n"), F.asc("topic")], 5).select("topic", "n", "share")


@query("r20_agent_listing", "SELECT user_id, max(ts) AS last_seen, max(ts) < (SELECT max(ts) FROM events) - INTERVAL 2 DAY AS inactive FROM events GROUP BY user_id ORDER BY last_seen DESC, user_id LIMIT 100")
def r20(spark, sf):
    e = table(spark, sf, "events")
    last = e.groupBy("user_id").agg(F.max("ts").alias("last_seen")).join(F.broadcast(e.agg(F.max("ts").alias("_m"))))
    out = last.withColumn("inactive", F.col("last_seen") < F.col("_m") - F.expr("INTERVAL 2 DAYS"))
    return stores.page(out, [F.desc("last_seen"), F.asc("user_id")], 100).select("user_id", "last_seen", "inactive")


@query("r29_profile", with_views("SELECT fact_type, place, id FROM (SELECT fact_type, id, row_number() OVER (PARTITION BY fact_type ORDER BY importance DESC, id) AS place FROM facts WHERE NOT is_superseded) WHERE place <= 3", FACTS))
def r29(spark, sf):
    top = windows.top_per(facts(spark, sf).where("not is_superseded"), ["fact_type"], [F.desc("importance"), F.asc("id")], 3)
    return top.select("fact_type", F.col("place").cast("long").alias("place"), "id")


@query("u04_merged_messages")
def u04(spark, sf):
    """Each conversation's user messages merged with all of its messages: equal beginnings once, order kept."""
    w = table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", "text")))).alias("u"), F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("a"))
    texts = lambda c: F.transform(c, lambda x: x["text"])
    return w.select("conv_id", F.size(learning.merged_messages(texts(F.col("u")), texts(F.col("a")))).alias("n"))


@query("a10_topic_shares", with_views("SELECT topic, round(avg(importance), 6) AS importance, count(*) AS n FROM episodes GROUP BY topic", EPISODES))
def a10b(spark, sf):
    return episodes(spark, sf).groupBy("topic").agg(r6(F.avg("importance")).alias("importance"), F.count("*").alias("n"))
