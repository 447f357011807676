"""Further queries: reports, history, links, extraction, compression, packing and the learning loop in batch form."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memloom.functions import scoring as sc
from memloom.functions.text import word_count, words
from memloom.operators import analytics, graph, learning, pairs, search, stores, windows
from memloom.plans.catalog import query
from memloom.plans.indexes import text_index
from memloom.plans.search_queries import BM25, STOPS, TF, W
from memloom.plans.views import EPISODES, FACTS, FEEDBACK, LINKS, as_of, episodes, facts, feedback, links, table, with_views


def r6(c):
    return F.round(c, 6)


@query("s10_export_round_trip", "SELECT conv_id AS id, count(*) AS n_messages, string_agg(trim(text, E' \\t\\n\\r'), '|' ORDER BY turn) AS said FROM conversations WHERE text IS NOT NULL AND trim(text) <> '' GROUP BY conv_id")
def s10(spark, sf):
    """Conversations written as JSON and parsed with the export's schema."""
    c = table(spark, sf, "conversations").where("text is not null and trim(text) <> ''")
    raw = c.groupBy("conv_id").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.struct(m["role"].alias("sender"), m["text"].alias("text"))).alias("chat_messages"))).alias("json"))
    parsed = raw.select("conv_id", F.from_json("json", "chat_messages array<struct<sender:string,text:string>>")["chat_messages"].alias("m"))
    return parsed.select(F.col("conv_id").alias("id"), F.size("m").cast("long").alias("n_messages"), F.array_join(F.transform("m", lambda m: F.trim(m["text"])), "|").alias("said"))


@query("s18_user_statements", f"SELECT conv_id, turn, len(list_distinct(list_filter(list_transform(string_split(text, '. '), lambda s: regexp_replace(trim(s), '[.,!?]+$', '')), lambda s: length(s) > 10 AND length(s) < 500 AND contains(lower(s), 'the')))) AS n FROM conversations WHERE role = 'user'")
def s18(spark, sf):
    parts = F.transform(F.split("text", r"\. "), lambda s: F.regexp_replace(F.trim(s), r"[.,!?]+$", ""))
    kept = F.array_distinct(F.filter(parts, lambda s: (F.length(s) > 10) & (F.length(s) < 500) & F.contains(F.lower(s), F.lit("the"))))
    return table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", F.size(kept).cast("long").alias("n"))


@query("s25_episode_ingest", "SELECT event_id, CASE event_type WHEN 'error' THEN -1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END AS valence, ts::DATE::VARCHAR AS day FROM events WHERE length(props) >= 9")
def s25(spark, sf):
    levels = F.create_map(*(F.lit(x) for pair in (("error", -1), ("purchase", 2), ("signup", 1)) for x in pair))
    return table(spark, sf, "events").where(F.length("props") >= 9).select("event_id", F.coalesce(levels[F.col("event_type")], F.lit(0)).alias("valence"), F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query("s35_index_rebuild", with_views(f"SELECT term, count(*) AS rows, sum(tf)::BIGINT AS hits FROM (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(regexp_extract_all(lower(content), '{W}')) AS term FROM facts) GROUP BY ALL) GROUP BY term", FACTS))
def s35(spark, sf):
    return search.postings(facts(spark, sf), "id", "content").groupBy("term").agg(F.count("*").alias("rows"), F.sum("tf").alias("hits"))


@query("p06_pool_search", "SELECT page_id, url FROM pages WHERE contains(lower(url), 'example.org') ORDER BY page_id DESC LIMIT 20")
def p06(spark, sf):
    return stores.page(table(spark, sf, "pages").where(F.lower("url").like("%example.org%")), [F.desc("page_id")], 20).select("page_id", "url")


@query("p08_edges_of_a_node", with_views("SELECT source, target, kind, weight FROM links WHERE (source = 12 OR target = 12) AND weight >= 0.1", LINKS))
def p08(spark, sf):
    return links(spark, sf).where("(source = 12 or target = 12) and weight >= 0.1").select("source", "target", "kind", "weight")


@query("p13_serialized", with_views("SELECT id, substr(summary, 1, 20) AS title, topic, CASE valence WHEN -2 THEN 'very_negative' WHEN -1 THEN 'negative' WHEN 0 THEN 'neutral' WHEN 1 THEN 'positive' ELSE 'very_positive' END AS mood FROM episodes", EPISODES))
def p13(spark, sf):
    from memloom.functions.fixed import VALENCES

    names = F.create_map(*(F.lit(x) for pair in VALENCES.items() for x in pair))
    return episodes(spark, sf).select("id", F.substring("summary", 1, 20).alias("title"), "topic", names[F.col("valence").cast("int")].alias("mood"))


@query("p16_supersede", with_views("SELECT id, is_superseded OR s IS NOT NULL AS is_superseded, s AS superseded_by FROM facts LEFT JOIN (SELECT target * 1000 AS t, max(source * 1000) AS s FROM links WHERE kind = 'similar' GROUP BY 1) x ON x.t = id", FACTS, LINKS))
def p16(spark, sf):
    by = links(spark, sf).where("kind = 'similar'").groupBy((F.col("target") * 1000).alias("id")).agg(F.max(F.col("source") * 1000).alias("superseded_by"))
    return facts(spark, sf).join(by, "id", "left").select("id", (F.col("is_superseded") | F.col("superseded_by").isNotNull()).alias("is_superseded"), "superseded_by")


@query("p17_protect", with_views("SELECT id, CASE WHEN topic = 'alpha' THEN 1.0::DOUBLE ELSE importance END AS importance, topic = 'alpha' AS protected FROM episodes", EPISODES))
def p17(spark, sf):
    hit = F.col("topic") == "alpha"
    return episodes(spark, sf).select("id", F.when(hit, 1.0).otherwise(F.col("importance")).alias("importance"), hit.alias("protected"))


@query("j05_episode_duplicates", with_views(f"SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6)::DOUBLE AS likeness FROM ew a JOIN ew b ON a.id < b.id WHERE len(list_intersect(a.w, b.w)) / greatest(1, len(list_distinct(list_concat(a.w, b.w)))) >= 0.2", EPISODES, f"ew AS (SELECT id, list_distinct(regexp_extract_all(lower(summary), '{W}')) AS w FROM episodes)"))
def j05(spark, sf):
    """All pairs of summaries as sets of words, in blocks."""
    sets = episodes(spark, sf).select("id", F.array_distinct(words(F.col("summary"))).alias("w"))
    return pairs.like_sets(sets, 0.2).withColumn("likeness", r6(F.col("likeness")))


@query("j12_referential_insert", with_views("SELECT source, target, kind FROM links WHERE source IN (SELECT id FROM episodes) AND target IN (SELECT id FROM episodes)", EPISODES, LINKS))
def j12(spark, sf):
    ids = episodes(spark, sf).select("id")
    ok = links(spark, sf).join(ids, F.col("source") == F.col("id"), "left_semi").join(ids, F.col("target") == F.col("id"), "left_semi")
    return ok.select("source", "target", "kind")


@query("j16_lag_chains", with_views("SELECT topic, chain, count(*) AS n, min(id) AS first_id FROM (SELECT *, sum(new) OVER (PARTITION BY topic ORDER BY started_at, id) AS chain FROM (SELECT *, CASE WHEN date_diff('second', lag(started_at) OVER w, started_at) <= 168 * 3600 THEN 0 ELSE 1 END AS new FROM episodes WINDOW w AS (PARTITION BY topic ORDER BY started_at, id))) GROUP BY topic, chain HAVING count(*) >= 2", EPISODES))
def j16(spark, sf):
    out = windows.sessions(episodes(spark, sf), ["topic"], "started_at", [F.col("started_at"), F.col("id")], 168 * 3600)
    return out.groupBy("topic", F.col("session").alias("chain")).agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n >= 2")


@query("j19_neighbours_with_content", with_views("SELECT l.source, l.target, e.topic FROM links l LEFT JOIN episodes e ON e.id = l.target", EPISODES, LINKS))
def j19(spark, sf):
    return links(spark, sf).join(episodes(spark, sf).select(F.col("id").alias("target"), "topic"), "target", "left").select("source", "target", "topic")


@query("a07_valence_histogram", with_views("SELECT valence, CASE WHEN importance >= 0.7 THEN 'high' WHEN importance >= 0.3 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM episodes GROUP BY ALL", EPISODES))
def a07(spark, sf):
    return episodes(spark, sf).groupBy("valence", analytics.buckets(F.col("importance"), [("high", 0.7), ("medium", 0.3)], "low").alias("band")).agg(F.count("*").alias("n"))


@query("a19_quality_stats", with_views("""SELECT issue, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM (SELECT confidence, unnest(list_filter([CASE WHEN confidence < 0.5 THEN 'low confidence' END, CASE WHEN len(tags) = 0 THEN 'no tags' END, CASE WHEN length(content) < 30 THEN 'short' END, CASE WHEN access_count = 0 THEN 'never used' END], lambda x: x IS NOT NULL)) AS issue FROM facts) GROUP BY issue""", FACTS))
def a19(spark, sf):
    issues = F.array_compact(F.array(F.when(F.col("confidence") < 0.5, F.lit("low confidence")), F.when(F.size("tags") == 0, F.lit("no tags")), F.when(F.length("content") < 30, F.lit("short")), F.when(F.col("access_count") == 0, F.lit("never used"))))
    return facts(spark, sf).select("confidence", F.explode(issues).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"), r6(F.avg("confidence")).alias("mean_confidence"))


@query("a20_duplicate_stats", with_views("""SELECT count(*) AS pairs, round(max(s), 6)::DOUBLE AS most, round(avg(s), 6)::DOUBLE AS mean FROM (SELECT dot / sqrt((sa + c * (na.n - sa)) * (sb + c * (nb.n - sb))) AS s FROM
  (SELECT p.id AS a, q.id AS b, sum(p.tf * q.tf) AS dot, sum(p.tf * p.tf) AS sa, sum(q.tf * q.tf) AS sb FROM tf p JOIN tf q ON p.term = q.term AND p.id < q.id GROUP BY 1, 2) x
  JOIN (SELECT id, sum(tf * tf) AS n FROM tf GROUP BY id) na ON na.id = a JOIN (SELECT id, sum(tf * tf) AS n FROM tf GROUP BY id) nb ON nb.id = b, (SELECT pow(1 + ln(1.5), 2) AS c)) WHERE s > 0.25""", FACTS, STOPS, TF))
def a20(spark, sf):
    p = pairs.similar_pairs(facts(spark, sf), "id", "content", 0.25)
    return p.agg(F.count("*").alias("pairs"), r6(F.max("similarity")).alias("most"), r6(F.avg("similarity")).alias("mean"))


@query("a24_conversation_rollup", "SELECT conv_id, count(*) AS messages, count(*) FILTER (role = 'user') AS by_user, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id")
def a24(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("messages"), F.count_if(F.col("role") == "user").alias("by_user"), F.sum(F.length("text")).alias("chars"))


@query("a29_weighted_valence", with_views("SELECT topic, round(sum(valence * importance) / sum(importance), 6) AS valence, arg_max(valence, s) AS dominant FROM (SELECT topic, valence, importance, sum(importance) OVER (PARTITION BY topic, valence) + valence / 1000.0::DOUBLE AS s FROM episodes) GROUP BY topic", EPISODES))
def a29(spark, sf):
    sums = episodes(spark, sf).groupBy("topic", "valence").agg(F.sum("importance").alias("_i"))
    return sums.groupBy("topic").agg(r6(F.sum(F.col("valence") * F.col("_i")) / F.sum("_i")).alias("valence"), F.max_by("valence", F.col("_i") + F.col("valence") / 1000.0).alias("dominant"))


@query("w01_rank_scores", with_views("SELECT id, round(1 - (row_number() OVER (ORDER BY round(score, 9) DESC, id) - 1) / ((SELECT count(*) FROM scored) + 1.0), 6)::DOUBLE AS score FROM scored", FACTS, BM25.replace("{prefixes}", "('sch'), ('the')")))
def w01(spark, sf):
    """Places come from counts by score and within equal scores, so no task ranks all hits."""
    hits = text_index(spark, sf).bm25(["sch", "the"]).withColumn("_s", F.round("score", 9))
    n = hits.groupBy("_s").agg(F.count("*").alias("_c"))
    before = n.select("_s", (F.sum("_c").over(Window.orderBy(F.desc("_s"))) - F.col("_c")).alias("_before"), F.sum("_c").over(Window.partitionBy()).alias("_all"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_s").orderBy("id"))
    return hits.join(before, "_s").select("id", r6(1 - (place - 1) / (F.col("_all") + 1.0)).alias("score"))


@query("w06_recency_normalised", with_views("SELECT id, round(date_diff('second', (SELECT min(started_at) FROM episodes), started_at) / date_diff('second', (SELECT min(started_at) FROM episodes), (SELECT max(started_at) FROM episodes))::DOUBLE, 6) AS recency FROM episodes", EPISODES))
def w06(spark, sf):
    ends = episodes(spark, sf).agg(F.min("started_at").alias("_a"), F.max("started_at").alias("_b"))
    span = F.timestamp_diff("SECOND", F.col("_a"), F.col("_b"))
    return episodes(spark, sf).join(F.broadcast(ends)).select("id", r6(F.timestamp_diff("SECOND", F.col("_a"), F.col("started_at")) / span).alias("recency"))


@query("w08_topic_shift", f"""SELECT conv_id, turn, round(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6)::DOUBLE AS likeness FROM (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)), '{W}')) AS a,
  list_distinct(regexp_extract_all(lower(string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)), '{W}')) AS b FROM conversations) WHERE a IS NOT NULL""")
def w08(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    sets = table(spark, sf, "conversations").withColumn("_w", words(F.col("text")))
    near = sets.withColumn("_a", F.array_distinct(F.flatten(F.collect_list("_w").over(w.rowsBetween(-5, -1))))).withColumn("_b", F.array_distinct(F.flatten(F.collect_list("_w").over(w.rowsBetween(0, 4)))))
    size = F.size(F.array_union("_a", "_b"))
    return near.where("turn > 0").select("conv_id", "turn", r6(F.when(size > 0, F.size(F.array_intersect("_a", "_b")) / size).otherwise(0.0)).alias("likeness"))


@query("w12_bounded_history", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 10")
def w12(spark, sf):
    return windows.top_per(table(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 10).select("user_id", "event_id")


@query("t07_budget_with_skips")
def t07(spark, sf):
    """Within each conversation the messages by length that fit 300 tokens; one that doesn't fit is skipped."""
    items = table(spark, sf, "conversations").select("conv_id", "turn", F.floor(F.length("text") / 4).cast("long").alias("tokens"))
    ordered = items.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("tokens")).alias("o"), F.col("turn").alias("id"), "tokens"))).alias("i"))
    return ordered.select("conv_id", F.array_join(F.transform(learning.packed(F.col("i"), 300), lambda x: x.cast("string")), ",").alias("turns"))


@query("t12_emotional_order", with_views("SELECT id, place FROM (SELECT id, row_number() OVER (ORDER BY abs(valence - 1), importance DESC, id) AS place FROM episodes) WHERE place <= 10", EPISODES))
def t12(spark, sf):
    top = stores.page(episodes(spark, sf).withColumn("_d", F.abs(F.col("valence") - 1)), [F.asc("_d"), F.desc("importance"), F.asc("id")], 10)
    return top.select("id", F.row_number().over(Window.orderBy("_d", F.desc("importance"), "id")).cast("long").alias("place"))


@query("t14_top_terms", f"SELECT conv_id, term, c FROM (SELECT conv_id, term, count(*) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY count(*) DESC, min(pos)) AS r FROM (SELECT conv_id, unnest(ws) AS term, unnest(range(len(ws))) AS pos FROM (SELECT conv_id, regexp_extract_all(lower(string_agg(text, ' ' ORDER BY turn)), '{W}') AS ws FROM conversations GROUP BY conv_id)) GROUP BY conv_id, term) WHERE r <= 5")
def t14(spark, sf):
    """By count, then by the first place: message, then word within it."""
    w = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(words(F.col("text"))).alias("pos", "term"))
    counts = w.groupBy("conv_id", "term").agg(F.count("*").alias("c"), F.min(F.struct("turn", "pos")).alias("_p"))
    return windows.top_per(counts, ["conv_id"], [F.desc("c"), F.asc("_p")], 5).select("conv_id", "term", "c")


@query("u03_tag_sets", with_views("SELECT source_episode, array_to_string(list_sort(list_distinct(flatten(list(tags)))), ',') AS tags FROM facts GROUP BY source_episode", FACTS))
def u03(spark, sf):
    tags = facts(spark, sf).select("source_episode", F.explode_outer("tags").alias("tag")).groupBy("source_episode").agg(F.collect_set("tag").alias("t"))
    return tags.select("source_episode", F.array_join(F.array_sort("t"), ",").alias("tags"))


@query("u05_merged_maps")
def u05(spark, sf):
    kept = F.create_map(F.lit("type"), F.col("fact_type"), F.lit("note"), F.lit(None).cast("string"))
    other = F.create_map(F.lit("note"), F.col("category"), F.lit("id"), F.col("id").cast("string"))
    return facts(spark, sf).select("id", F.to_json(learning.merged_maps(kept, other)).alias("merged"))


@query("d02_corpus_cosine", with_views("""SELECT x.a, x.b, round(dot / sqrt(na.n * nb.n), 6)::DOUBLE AS similarity FROM (SELECT p.id AS a, q.id AS b, sum(p.tf * q.tf * p.idf * p.idf) AS dot FROM wt p JOIN wt q ON p.term = q.term AND p.id < q.id GROUP BY 1, 2) x
  JOIN (SELECT id, sum(tf * tf * idf * idf) AS n FROM wt GROUP BY id) na ON na.id = a JOIN (SELECT id, sum(tf * tf * idf * idf) AS n FROM wt GROUP BY id) nb ON nb.id = b WHERE dot / sqrt(na.n * nb.n) > 0.15""", FACTS, STOPS, TF, "wt AS (SELECT id, term, tf, ln(((SELECT count(*) FROM facts) + 1) / ((count(*) OVER (PARTITION BY term)) + 1)) + 1 AS idf FROM tf)"))
def d02(spark, sf):
    """All pairs of facts; weights from the whole corpus."""
    return pairs.corpus_cosine(facts(spark, sf), "id", "content", 0.15).withColumn("similarity", r6(F.col("similarity")))


@query("d08_insert_or_confirm")
def d08(spark, sf):
    f = facts(spark, sf)
    store = f.where("source_episode < 50").select("id", "content", "confidence", "confirmation_count")
    return learning.insert_or_confirm(store, f.where("source_episode >= 50"), 0.5)


@query("k05_episode_freshness", with_views("SELECT id, round(greatest(0, least(1, importance * pow(0.5, date_diff('second', started_at, TIMESTAMP '2024-02-01') / 3600.0 / (168.0 * (1 + importance * 2) * (1 + 0.5 * ln(1 + access_count)) * (1 + 1.5 * abs(valence) / 2.0))) + 0.02)), 6)::DOUBLE AS freshness FROM episodes", EPISODES))
def k05(spark, sf):
    s = sc.adaptive_strength(sc.hours_between(F.col("started_at"), as_of()), F.col("importance"), F.col("access_count"), F.abs("valence") / 2.0, F.lit(0))
    return episodes(spark, sf).select("id", r6(s).alias("freshness"))


@query("k13_chunk_importance", "SELECT conv_id, round(least(1.0, 0.3 + 0.02 * count(*) + 0.1 * count(*) FILTER (ends_with(trim(text), '?'))), 6)::DOUBLE AS importance FROM conversations GROUP BY conv_id")
def k13(spark, sf):
    asked = F.count_if(F.endswith(F.trim("text"), F.lit("?")))
    return table(spark, sf, "conversations").groupBy("conv_id").agg(r6(F.least(F.lit(1.0), 0.3 + 0.02 * F.count("*") + 0.1 * asked)).alias("importance"))


@query("k14_mood_by_week", with_views("SELECT week, round(mean, 6) AS mean, CASE WHEN mean < base - 0.5 * spread THEN 'low' WHEN mean > base + 0.5 * spread THEN 'elevated' ELSE 'usual' END AS mood FROM (SELECT strftime(started_at, '%Y-W%W') AS week, avg(valence / 2.0::DOUBLE) AS mean FROM episodes GROUP BY 1), (SELECT avg(valence / 2.0::DOUBLE) AS base, greatest(0.1, stddev_pop(valence / 2.0::DOUBLE)) AS spread FROM episodes)", EPISODES))
def k14(spark, sf):
    from memloom.functions.text import week_key

    v = F.col("valence") / 2.0
    base = episodes(spark, sf).agg(F.avg(v).alias("_b"), F.greatest(F.lit(0.1), F.stddev_pop(v)).alias("_s"))
    weeks = episodes(spark, sf).groupBy(week_key(F.col("started_at")).alias("week")).agg(F.avg(v).alias("_m")).join(F.broadcast(base))
    mood = F.when(F.col("_m") < F.col("_b") - 0.5 * F.col("_s"), "low").when(F.col("_m") > F.col("_b") + 0.5 * F.col("_s"), "elevated").otherwise("usual")
    return weeks.select("week", r6(F.col("_m")).alias("mean"), mood.alias("mood"))


@query("x16_first_sentences", "SELECT conv_id, turn, string_split_regex(text, '[.!?]\\s+')[1] AS lead, len(string_split_regex(text, '[.!?]\\s+')) AS n FROM conversations WHERE role = 'assistant'")
def x16(spark, sf):
    parts = F.split("text", r"[.!?]\s+")
    return table(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.get(parts, F.lit(0)).alias("lead"), F.size(parts).cast("long").alias("n"))


ARTICLES = ("the", "a", "an", "of", "die", "der", "la", "le", "de")


@query("x18_compression", f"SELECT conv_id, turn, length(text) AS before, length(array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '' AND lower(w) NOT IN {ARTICLES}), ' ')) AS after_ FROM conversations")
def x18(spark, sf):
    """The second level: articles and the like go, white space is collapsed."""
    drop = F.array(*map(F.lit, ("", *ARTICLES)))
    short = F.array_join(F.filter(F.split("text", r"\s+"), lambda w: ~F.array_contains(drop, F.lower(w))), " ")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("before"), F.length(short).cast("long").alias("after_"))


@query("x19_tag_suggestions", "SELECT page_id, array_to_string(list_filter(['blog', 'page', 'feed', 'shop'], lambda t: contains(lower(url), t)), ',') AS tags FROM pages")
def x19(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.array_join(learning.suggested_tags(F.regexp_replace("url", "#", ""), ("blog", "page", "feed", "shop")), ",").alias("tags"))


@query("x30_context_text", with_views("SELECT fact_type, string_agg('- ' || id, chr(10) ORDER BY importance DESC, id) AS context FROM (SELECT *, row_number() OVER (PARTITION BY fact_type ORDER BY importance DESC, id) AS n FROM facts) WHERE n <= 5 GROUP BY fact_type", FACTS))
def x30(spark, sf):
    top = windows.top_per(facts(spark, sf), ["fact_type"], [F.desc("importance"), F.asc("id")], 5)
    return top.groupBy("fact_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: F.concat(F.lit("- "), x["id"].cast("string"))), "\n").alias("context"))


@query("g01_edge_upsert", with_views("SELECT source, target, kind, max(weight) AS weight FROM (SELECT source, target, kind, weight FROM links UNION ALL SELECT target, source, kind, weight / 2 FROM links) WHERE source <> target GROUP BY ALL", LINKS))
def g01(spark, sf):
    edges = links(spark, sf).select("source", "target", "kind", "weight")
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "kind", (F.col("weight") / 2).alias("weight"))
    return edges.unionByName(back).where("source <> target").groupBy("source", "target", "kind").agg(F.max("weight").alias("weight"))


@query("g06_similarity_links", with_views("""SELECT a AS source, b AS target, round(s, 6)::DOUBLE AS weight FROM (SELECT a, b, dot / sqrt((sa + c * (na.n - sa)) * (sb + c * (nb.n - sb))) AS s FROM
  (SELECT p.id AS a, q.id AS b, sum(p.tf * q.tf) AS dot, sum(p.tf * p.tf) AS sa, sum(q.tf * q.tf) AS sb FROM tf p JOIN tf q ON p.term = q.term AND p.id < q.id GROUP BY 1, 2) x
  JOIN (SELECT id, sum(tf * tf) AS n FROM tf GROUP BY id) na ON na.id = a JOIN (SELECT id, sum(tf * tf) AS n FROM tf GROUP BY id) nb ON nb.id = b, (SELECT pow(1 + ln(1.5), 2) AS c)) WHERE s > 0.4""", FACTS, STOPS, TF))
def g06(spark, sf):
    p = pairs.similar_pairs(facts(spark, sf), "id", "content", 0.4)
    return p.select(F.col("a").alias("source"), F.col("b").alias("target"), r6(F.col("similarity")).alias("weight"))


@query("g09_graph_as_json", with_views("SELECT 'episode:' || id AS node, 'episode' AS kind FROM episodes UNION ALL SELECT 'fact:' || id, 'fact' FROM facts UNION ALL SELECT DISTINCT 'topic:' || topic, 'topic' FROM episodes", FACTS, EPISODES))
def g09(spark, sf):
    """Nodes written as JSON lines and read back."""
    nodes = graph.property_graph(episodes(spark, sf), facts(spark, sf), links(spark, sf))[0]
    return nodes.select(F.from_json(F.to_json(F.struct("node", "kind")), "node string, kind string").alias("n")).select("n.*")


@query("e06_pool_since", "SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 6 HOUR")
def e06(spark, sf):
    e = table(spark, sf, "events")
    return e.join(F.broadcast(e.agg(F.max("ts").alias("_m"))), F.col("ts") > F.col("_m") - F.expr("INTERVAL 6 HOURS")).select("event_id")


@query("e11_confirmation_log", with_views("SELECT fact_id, count(*) AS hits, count(DISTINCT ts::DATE) AS days FROM feedback WHERE is_positive GROUP BY fact_id", FEEDBACK))
def e11(spark, sf):
    return feedback(spark, sf).where("is_positive").groupBy("fact_id").agg(F.count("*").alias("hits"), F.count_distinct(F.to_date("ts")).alias("days"))


@query("e12_consolidation", "SELECT conv_id AS id, n, round(least(1, 0.3 + least(0.2, 0.05 * ln(1 + n)) + CASE WHEN u > 1 THEN 0.2 ELSE 0 END), 6)::DOUBLE AS importance FROM (SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'user') AS u FROM conversations GROUP BY conv_id) WHERE n >= 2")
def e12(spark, sf):
    c = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.count("*").alias("n"), F.count_if(F.col("role") == "user").alias("u")).where("n >= 2")
    return c.select("id", "n", r6(sc.consolidation_importance(F.col("n"), F.col("u") > 1, F.lit(False), F.lit(0.0))).alias("importance"))


@query("r13_bulk_delete_counts", with_views("SELECT count(*) FILTER (f.id IS NOT NULL) AS deleted, count(*) FILTER (f.id IS NULL) AS missing FROM (SELECT DISTINCT target * 1000 AS id FROM links) k LEFT JOIN facts f ON f.id = k.id", FACTS, LINKS))
def r13(spark, sf):
    keys = links(spark, sf).select((F.col("target") * 1000).alias("id")).distinct()
    met = keys.join(facts(spark, sf).select("id", F.lit(True).alias("_hit")), "id", "left")
    return met.agg(F.count_if(F.col("_hit")).alias("deleted"), F.count_if(F.col("_hit").isNull()).alias("missing"))


@query("r18_budget_tiers", "SELECT budget, count(*) AS n, min(vram) AS least, max(vram) AS greatest FROM (SELECT c_custkey % 50 + 1 AS vram, CASE WHEN c_custkey % 50 + 1 <= 8 THEN 200 WHEN c_custkey % 50 + 1 <= 16 THEN 500 WHEN c_custkey % 50 + 1 <= 24 THEN 1000 ELSE 2000 END AS budget FROM customer) GROUP BY budget")
def r18(spark, sf):
    v = F.col("vram")
    machines = table(spark, sf, "customer").select((F.col("c_custkey") % 50 + 1).alias("vram"))
    return machines.withColumn("budget", F.when(v <= 8, 200).when(v <= 16, 500).when(v <= 24, 1000).otherwise(2000)).groupBy("budget").agg(F.count("*").alias("n"), F.min("vram").alias("least"), F.max("vram").alias("greatest"))


@query("r21_status_rollup", "SELECT count(DISTINCT user_id) AS agents, count(*) FILTER (event_type = 'signup') AS notes, count(*) FILTER (event_type = 'view') AS shared FROM events")
def r21(spark, sf):
    return table(spark, sf, "events").agg(F.count_distinct("user_id").alias("agents"), F.count_if(F.col("event_type") == "signup").alias("notes"), F.count_if(F.col("event_type") == "view").alias("shared"))


@query("r23_context_usage", with_views("SELECT fact_type, sum(length(content) // 4)::BIGINT AS tokens, sum(len(list_filter(string_split_regex(content, '\\s+'), lambda w: w <> '')))::BIGINT AS words FROM facts GROUP BY fact_type", FACTS))
def r23(spark, sf):
    return facts(spark, sf).groupBy("fact_type").agg(F.sum(F.floor(F.length("content") / 4)).alias("tokens"), F.sum(word_count(F.col("content"))).alias("words"))


@query("x02_keyword_sets", "SELECT conv_id, turn, len(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]{4,}'), lambda w: w NOT IN ('that', 'with', 'this', 'from')))) AS n FROM conversations")
def x02(spark, sf):
    keys = F.array_except(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})"), F.lit(1)), F.array(*map(F.lit, ("that", "with", "this", "from"))))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.size(keys).cast("long").alias("n"))


@query("x09_entities", r"SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(text, '\p{L}+'), lambda w: regexp_full_match(w, '[A-Z][a-z]{4,}')))), '|') AS names FROM conversations WHERE role = 'user'")
def x09(spark, sf):
    names = F.filter(F.regexp_extract_all("text", F.lit(r"(\p{L}+)"), F.lit(1)), lambda w: F.rlike(w, F.lit("^[A-Z][a-z]{4,}$")))
    return table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", F.array_join(F.array_sort(F.array_distinct(names)), "|").alias("names"))
