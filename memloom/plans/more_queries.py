"""Queries over exports, contradictions, merges, clusters, chunks, expansion and the learning loop."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from memloom.functions import scoring as sc
from memloom.functions.fixed import EMOTIONS, SYNONYMS
from memloom.functions.sentiment import with_sentiment
from memloom.functions.temporal import MONTHS, parse, time_range
from memloom.functions.text import jaccard, strings, words
from memloom.operators import conversations, graph, learning, stores, windows
from memloom.plans.catalog import query
from memloom.plans.indexes import text_index
from memloom.plans.search_queries import BM25, FRESH, QUALITY, W
from memloom.plans.views import AS_OF, EPISODES, FACTS, LINKS, TOLD_FACTS, as_of, episodes, facts, links, table, told_facts, with_views


def r6(c):
    return F.round(c, 6)


@query("s20_tree_export", "SELECT conv_id, turn, trim(text) AS content FROM conversations WHERE role = 'user' AND trim(coalesce(text, '')) <> ''")
def s20(spark, sf):
    """Conversations as tree-shaped JSON, read with that export's schema: users' messages."""
    node = F.struct(F.struct(F.struct(F.col("role")).alias("author"), F.struct(F.array(F.trim("text")).alias("parts")).alias("content")).alias("message"))
    tree = table(spark, sf, "conversations").where("text is not null").groupBy("conv_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("turn").cast("string"), node)))).alias("json"))
    parsed = tree.select("conv_id", F.explode(F.from_json("json", "map<string,struct<message:struct<author:struct<role:string>,content:struct<parts:array<string>>>>>")).alias("turn", "n"))
    said = parsed.where("n.message.author.role = 'user'").select("conv_id", F.col("turn").cast("long").alias("turn"), F.array_join("n.message.content.parts", " ").alias("content"))
    return said.where("content <> ''")


@query("s14_sentences", "SELECT conv_id, turn, count(*) AS sentences FROM (SELECT conv_id, turn, unnest(string_split_regex(replace(trim(text), chr(10), ' '), '[.!?]\\s+')) AS s FROM conversations) WHERE trim(s) <> '' GROUP BY ALL")
def s14(spark, sf):
    parts = F.explode(F.split(F.regexp_replace(F.trim("text"), "\n", " "), r"(?<=[.!?])\s+"))
    return table(spark, sf, "conversations").select("conv_id", "turn", parts.alias("s")).where("trim(s) <> ''").groupBy("conv_id", "turn").agg(F.count("*").alias("sentences"))


@query("s33_sanitized_names", "SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[^A-Za-z0-9._-]+', '_', 'g') AS name FROM pages")
def s33(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[^A-Za-z0-9._-]+", "_").alias("name"))


@query("j10_best_match", with_views(f"""SELECT id, round(max(s), 6)::DOUBLE AS best FROM (SELECT e.id, len(list_intersect(e.w, q.w)) / greatest(1, len(list_distinct(list_concat(e.w, q.w)))) AS s FROM ew e, (SELECT w FROM ew WHERE id = 3) q WHERE e.id <> 3) GROUP BY id HAVING max(s) > 0""", EPISODES, f"ew AS (SELECT id, list_distinct(regexp_extract_all(lower(summary), '{W}')) AS w FROM episodes)"))
def j10(spark, sf):
    """One row against the table: the one row is broadcast."""
    sets = episodes(spark, sf).select("id", F.array_distinct(words(F.col("summary"))).alias("w"))
    anchor = sets.where("id = 3").select(F.col("w").alias("q"))
    return sets.where("id <> 3").join(F.broadcast(anchor)).select("id", r6(jaccard(F.col("w"), F.col("q"))).alias("best")).where("best > 0")


@query("j08_number_conflicts", with_views("""SELECT a.id AS a, b.id AS b FROM n a JOIN n b ON a.source_episode = b.source_episode AND a.fact_type = b.fact_type AND a.id < b.id WHERE len(a.d) > 0 AND len(b.d) > 0 AND NOT list_has_any(a.d, b.d)""", FACTS, "n AS (SELECT id, source_episode, fact_type, list_distinct(regexp_extract_all(content || ' ' || id, '[0-9]+')) AS d FROM facts)"))
def j08(spark, sf):
    """Facts of one conversation and type that name different numbers; a conversation is a bounded group."""
    n = facts(spark, sf).select("id", "source_episode", "fact_type", F.array_distinct(F.regexp_extract_all(F.concat("content", F.lit(" "), "id"), F.lit("([0-9]+)"), F.lit(1))).alias("d"))
    b = n.select(F.col("id").alias("b"), "source_episode", "fact_type", F.col("d").alias("db"))
    p = n.join(b, ["source_episode", "fact_type"]).where("id < b and size(d) > 0 and size(db) > 0 and not arrays_overlap(d, db)")
    return p.select(F.col("id").alias("a"), "b")


@query("q02_store_search", with_views("SELECT id, round(score, 6)::DOUBLE AS score FROM (SELECT id, score FROM scored ORDER BY round(score, 9) DESC, id LIMIT 30) h JOIN facts f USING (id) WHERE NOT is_superseded", FACTS, BM25.replace("{prefixes}", "('ver'), ('ción')")))
def q02(spark, sf):
    hits = text_index(spark, sf).bm25(["ver", "ción"]).orderBy(F.desc(F.round("score", 9)), "id").limit(30)
    return facts(spark, sf).where("not is_superseded").join(hits, "id").select("id", r6(F.col("score")).alias("score"))


@query("q07_preview", with_views(f"SELECT id, round({FRESH}, 6)::DOUBLE AS freshness, CASE WHEN category = 'creative' THEN 1.3 ELSE 1.0 END::DOUBLE AS boost, round(ln(1 + confirmation_count), 6)::DOUBLE AS confirmation FROM facts JOIN (SELECT id FROM scored) USING (id)", FACTS, BM25.replace("{prefixes}", "('ver')")))
def q07(spark, sf):
    hits = text_index(spark, sf).bm25(["ver"]).select("id")
    fresh = sc.fact_freshness(sc.hours_between(F.col("last_confirmed"), as_of()), F.col("importance"), F.col("confirmation_count"))
    return facts(spark, sf).join(hits, "id").select("id", r6(fresh).alias("freshness"), F.when(F.col("category") == "creative", 1.3).otherwise(1.0).alias("boost"), r6(F.log1p("confirmation_count")).alias("confirmation"))


_CLASSED = ("tell me more", "compare dragon versus hero", "a dragon and the void", "tea", "what else and then", "the difference between fate and destiny")


def _class_sql() -> str:
    count = lambda needles: "(" + " + ".join(f"contains(low, '{n}')::INT" for n in (x.replace("'", "''") for x in needles)) + ")"
    themes = "[" + ", ".join(f"'{t}'" for t in sorted({t for g in SYNONYMS for t in g})) + "]"
    scores = f"least(1.0, {count(conversations.FOLLOW_UPS)} * 0.4) AS f, least(1.0, {count(conversations.COMPARISONS)} * 0.4) AS c, least(1.0, len(list_intersect(regexp_extract_all(low, '[\\p{{L}}\\p{{N}}_]+'), {themes})) * 0.3) AS t"
    asked = "['" + "', '".join(_CLASSED) + f"'][(conv_id + turn) % {len(_CLASSED)} + 1]"
    return f"SELECT q, CASE WHEN greatest(f, c, t) < 0.25 THEN 'general' WHEN f = greatest(f, c, t) THEN 'follow_up' WHEN c = greatest(f, c, t) THEN 'comparison' ELSE 'thematic' END AS class, count(*) AS n FROM (SELECT q, {scores} FROM (SELECT q, lower(q) AS low FROM (SELECT {asked} || ' ' || (turn % 2) AS q FROM conversations))) GROUP BY q, class"


@query("q08_query_classes", _class_sql())
def q08(spark, sf):
    """What kind of search each message's query asks for."""
    k = F.col("conv_id") + F.col("turn")
    asked = F.concat_ws(" ", F.element_at(F.array(*map(F.lit, _CLASSED)), (k % len(_CLASSED) + 1).cast("int")), (F.col("turn") % 2).cast("string"))
    return table(spark, sf, "conversations").select(asked.alias("q")).select("q", conversations.query_class(F.col("q")).alias("class")).groupBy("q", "class").agg(F.count("*").alias("n"))


@query("q10_accents", "SELECT conv_id, turn, translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy') AS plain FROM conversations WHERE role = 'user'")
def q10(spark, sf):
    plain = F.translate(F.lower("text"), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", plain.alias("plain"))


@query("d06_dedupe_apply", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def d06(spark, sf):
    """Equal texts: the least id stays. The text is met by two hashes, so no long text is shuffled."""
    d = table(spark, sf, "documents").select("doc_id", F.xxhash64("text").alias("h"), F.xxhash64(F.lit("second"), "text").alias("g"))
    return d.groupBy("h", "g").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


SAID = f"""said AS (SELECT DISTINCT id, s AS content FROM (SELECT id, regexp_replace(trim(unnest(string_split(content, '. '))), '[.,!?]+$', '') AS s FROM facts)
  WHERE length(s) > 10 AND length(s) < 500 AND ({' OR '.join("contains(lower(s), '" + m.replace("'", "''") + "')" for m in learning.SELF_MARKERS)}))"""


@query("x06_self_statements", with_views("SELECT id, content AS statement FROM said", TOLD_FACTS, SAID))
def x06(spark, sf):
    return learning.statements(told_facts(spark, sf).select("id", "content"), "content").select("id", "statement")


_YOU = ("Since you live in Oslo", "You're a pilot", "nothing", "I hear you work at night and your job is hard", "Your name is Anna")


def _first_person_sql() -> str:
    cases = " ".join("WHEN strpos(lower(said), {y}) > 0 THEN substr(said, 1, strpos(lower(said), {y}) - 1) || {i} || substr(said, strpos(lower(said), {y}) + {n})".format(y="'" + y.replace("'", "''") + "'", i="'" + i.replace("'", "''") + "'", n=len(y)) for y, i in learning.TO_FIRST)
    said = "['" + "', '".join(x.replace("'", "''") for x in _YOU) + f"'][(conv_id + turn) % {len(_YOU)} + 1]"
    return f"SELECT conv_id, turn, CASE {cases} ELSE said END AS own FROM (SELECT conv_id, turn, {said} || ' ' || turn AS said FROM conversations WHERE role = 'assistant')"


@query("x07_first_person", _first_person_sql())
def x07(spark, sf):
    said = F.concat_ws(" ", F.element_at(F.array(*map(F.lit, _YOU)), ((F.col("conv_id") + F.col("turn")) % len(_YOU) + 1).cast("int")), F.col("turn").cast("string"))
    return table(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", learning.first_person(said).alias("own"))


@query("x08_emotion_rows", with_views("SELECT emotion, count(*) AS n FROM (SELECT id, unnest(list_filter([" + ", ".join(f"CASE WHEN list_has_any(w, {k}) THEN '{n}' END" for n, (_, k) in EMOTIONS.items()) + f"], lambda x: x IS NOT NULL)) AS emotion FROM (SELECT id, regexp_extract_all(lower(content), '{W}') AS w FROM facts)) GROUP BY emotion", TOLD_FACTS))
def x08(spark, sf):
    """Every emotion that a fact names, counted."""
    w = told_facts(spark, sf).select("id", F.explode(F.array_distinct(words(F.col("content")))).alias("word"))
    known = spark.createDataFrame([(k, n) for n, (_, keys) in EMOTIONS.items() for k in keys], "word string, emotion string")
    return w.join(F.broadcast(known), "word").select("id", "emotion").distinct().groupBy("emotion").agg(F.count("*").alias("n"))


@query("x14_fiction_context", "SELECT conv_id, markers, CASE WHEN markers > 0 THEN 'fiction' ELSE 'reality' END AS context, CASE WHEN markers >= 3 THEN 0.9 WHEN markers >= 1 THEN 0.7 ELSE 0.8 END::DOUBLE AS confidence FROM (SELECT conv_id, sum(" + " + ".join(f"contains(lower(text), '{m}')::INT" for m in conversations.FICTION) + ")::BIGINT AS markers FROM conversations GROUP BY conv_id)")
def x14(spark, sf):
    return conversations.context(table(spark, sf, "conversations"), "conv_id", "text")


@query("x21_time_phrase", with_views("SELECT id, started_at FROM episodes WHERE started_at >= TIMESTAMP '2024-01-01' AND started_at < TIMESTAMP '2024-02-01'", EPISODES))
def x21(spark, sf):
    a, b = parse("what happened last month", datetime.fromisoformat(AS_OF))
    return episodes(spark, sf).where((F.col("started_at") >= F.lit(a).cast("timestamp_ntz")) & (F.col("started_at") < F.lit(b).cast("timestamp_ntz"))).select("id", "started_at")


@query("x23_recall_before", with_views("SELECT id, started_at FROM episodes WHERE topic = 'beta' AND started_at < (SELECT min(started_at) FROM episodes WHERE topic = 'alpha' AND started_at >= TIMESTAMP '2024-01-10') ORDER BY started_at DESC, id LIMIT 10", EPISODES))
def x23(spark, sf):
    e = episodes(spark, sf)
    bound = e.where((F.col("topic") == "alpha") & (F.col("started_at") >= F.lit("2024-01-10").cast("timestamp_ntz"))).agg(F.min("started_at").alias("_b"))
    hits = e.where("topic = 'beta'").join(F.broadcast(bound), F.col("started_at") < F.col("_b"))
    return stores.page(hits, [F.desc("started_at"), F.asc("id")], 10).select("id", "started_at")


@query("x24_chunks")
def x24(spark, sf):
    return conversations.chunks(table(spark, sf, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn", "text").select("conv_id", "turn", "chunk")


@query("x25_continuations", with_views("SELECT id, previous, round(least(1.0, 0.3 + 0.2 * greatest(0, 1 - gap / 3600.0 / 72)), 6)::DOUBLE AS score FROM (SELECT id, lag(id) OVER w AS previous, date_diff('second', lag(started_at) OVER w, started_at) AS gap FROM episodes WINDOW w AS (PARTITION BY topic ORDER BY started_at, id)) WHERE gap > 0 AND gap <= 168 * 3600", EPISODES))
def x25(spark, sf):
    p = windows.predecessors(episodes(spark, sf), "id", "topic", "started_at", 168)
    score = conversations.continuation(F.lit(0.0), F.lit(True), F.col("gap_hours"), F.lit(False))
    return p.select("id", "previous", r6(score).alias("score"))


@query("x29_merged_episodes", with_views("SELECT topic, count(*) AS parts, min(started_at) AS started_at, max(ended_at) AS ended_at, max(importance) AS importance, round(avg(valence))::BIGINT AS valence, sum(n_messages)::BIGINT AS n_messages FROM episodes WHERE valence IN (-2, 2) GROUP BY topic", EPISODES))
def x29(spark, sf):
    e = episodes(spark, sf).where("valence in (-2, 2)")
    return e.groupBy("topic").agg(
        F.count("*").alias("parts"), F.min("started_at").alias("started_at"), F.max("ended_at").alias("ended_at"), F.max("importance").alias("importance"),
        F.round(F.avg("valence")).cast("long").alias("valence"), F.sum("n_messages").alias("n_messages"))


@query("t10_keyword_clusters")
def t10(spark, sf):
    rows = episodes(spark, sf).withColumn("w", F.array_distinct(words(F.col("summary"))))
    return conversations.clusters(rows, "topic", "id", "w")


@query("t11_related", with_views("SELECT id, round(0.4 * (topic = 'delta')::INT + 0.6 * greatest(0, 1 - abs(date_diff('second', (SELECT started_at FROM episodes WHERE id = 3), started_at)) / (30 * 86400.0)), 6)::DOUBLE AS score FROM episodes WHERE id <> 3 ORDER BY score DESC, id LIMIT 5", EPISODES))
def t11(spark, sf):
    e = episodes(spark, sf)
    anchor = e.where("id = 3").select(F.col("started_at").alias("_at"), F.col("topic").alias("_topic"))
    near = F.greatest(F.lit(0.0), 1 - F.abs(F.timestamp_diff("SECOND", F.col("_at"), F.col("started_at"))) / (30 * 86_400.0))
    scored = e.where("id <> 3").join(F.broadcast(anchor)).withColumn("score", r6(F.when(F.col("topic") == F.col("_topic"), 0.4).otherwise(0.0) + 0.6 * near))
    return stores.page(scored, [F.desc("score"), F.asc("id")], 5).select("id", "score")


@query("g04_typed_walk", with_views("SELECT node, min(hops) AS hops FROM walk GROUP BY node", LINKS, "e AS (SELECT DISTINCT source, target FROM (SELECT source, target FROM links WHERE kind = 'similar' UNION ALL SELECT target, source FROM links WHERE kind = 'similar'))", "walk AS (SELECT 4::BIGINT AS node, 0 AS hops UNION SELECT e.target, hops + 1 FROM walk JOIN e ON e.source = walk.node WHERE hops < 3)").replace("WITH ", "WITH RECURSIVE ", 1))
def g04(spark, sf):
    return graph.neighbourhood(links(spark, sf).where("kind = 'similar'"), 4, 3, 0.0)


@query("g07_relationship_upsert", with_views("SELECT coalesce(o.source, n.source) AS source, coalesce(o.target, n.target) AS target, coalesce(n.weight, o.weight) AS weight, CASE WHEN o.source IS NULL THEN 'new' ELSE 'old' END AS created FROM (SELECT source, target, weight FROM links WHERE kind = 'similar') o FULL JOIN (SELECT source, target, weight / 2 AS weight FROM links WHERE kind = 'similar' AND source >= 50 UNION ALL SELECT target + 1000, source, 0.5 FROM links WHERE kind = 'similar' AND source >= 90) n ON o.source = n.source AND o.target = n.target", LINKS))
def g07(spark, sf):
    """A new weight replaces the old one; when a relationship was created stays."""
    old = links(spark, sf).where("kind = 'similar'").select("source", "target", "weight")
    again = old.where("source >= 50").withColumn("weight", F.col("weight") / 2)
    new = again.unionByName(old.where("source >= 90").select((F.col("target") + 1000).alias("source"), F.col("source").alias("target"), F.lit(0.5).alias("weight")))
    both = old.withColumn("_o", F.lit(True)).withColumnRenamed("weight", "_w").join(new, ["source", "target"], "full_outer")
    return both.select("source", "target", F.coalesce("weight", "_w").alias("weight"), F.when(F.col("_o"), "old").otherwise("new").alias("created"))


@query("g11_relinked", with_views("SELECT source, target, CASE WHEN weight < 0.2 THEN 'weak' ELSE kind END AS kind, least(1.0, weight + 0.1)::DOUBLE AS strength FROM links WHERE target <> 7", LINKS))
def g11(spark, sf):
    kind = F.when(F.col("weight") < 0.2, "weak").otherwise(F.col("kind"))
    return links(spark, sf).where("target <> 7").select("source", "target", kind.alias("kind"), F.least(F.lit(1.0), F.col("weight") + 0.1).alias("strength"))


@query("e09_learning_batch", with_views("SELECT gate, count(*) AS n FROM (SELECT CASE WHEN q >= 0.7 THEN 'high' WHEN q >= 0.4 THEN 'medium' ELSE 'low' END AS gate FROM (SELECT round(0.5 + CASE WHEN length(content) BETWEEN 30 AND 150 THEN 0.05 WHEN length(content) > 300 THEN -0.1 ELSE 0 END - CASE WHEN ends_with(rtrim(content), '?') THEN 0.3 ELSE 0 END, 9) AS q FROM facts)) GROUP BY gate", FACTS))
def e09(spark, sf):
    """The gate of the learning loop over all messages, by length and form alone."""
    size = F.length("content")
    q = F.round(0.5 + F.when(size.between(30, 150), 0.05).when(size > 300, -0.1).otherwise(0.0) - F.when(F.endswith(F.rtrim("content"), F.lit("?")), 0.3).otherwise(0.0), 9)
    return facts(spark, sf).groupBy(sc.gate(q).alias("gate")).agg(F.count("*").alias("n"))


@query("e09_gated_statements", with_views(f"SELECT gate, fact_type, count(*) AS n, round(avg(q), 6)::DOUBLE AS quality FROM (SELECT CASE WHEN q >= 0.7 THEN 'high' WHEN q >= 0.4 THEN 'medium' ELSE 'low' END AS gate, fact_type, q FROM (SELECT f.fact_type, round({QUALITY.replace('content', 'said.content')}, 9) AS q FROM said JOIN facts f ON f.id = said.id)) GROUP BY gate, fact_type", TOLD_FACTS, SAID))
def e09_gated(spark, sf):
    """What the learning loop extracts from all messages, and by its quality stores, queues or drops, for each type."""
    said = learning.statements(told_facts(spark, sf).select("id", "fact_type", "content"), "content").select("id", "fact_type", "statement").distinct()
    rated = said.withColumn("q", F.round(sc.fact_text_quality(F.col("statement")), 9))
    return rated.groupBy(sc.gate(F.col("q")).alias("gate"), "fact_type").agg(F.count("*").alias("n"), F.round(F.avg("q"), 6).alias("quality"))


@query("r01_mood_aware_recall", with_views("SELECT id, branch FROM (SELECT id, 'hit' AS branch FROM episodes WHERE topic = 'gamma' UNION ALL SELECT id, 'comfort' FROM (SELECT id FROM episodes WHERE valence = 2 AND topic <> 'gamma' ORDER BY importance DESC, id LIMIT 3))", EPISODES))
def r01(spark, sf):
    """Hits, and three comforting episodes beside them."""
    e = episodes(spark, sf)
    comfort = stores.page(e.where("valence = 2 and topic <> 'gamma'"), [F.desc("importance"), F.asc("id")], 3)
    return e.where("topic = 'gamma'").select("id", F.lit("hit").alias("branch")).unionAll(comfort.select("id", F.lit("comfort")))


@query("r03_texts_by_emotion", with_views("SELECT 'neutral' AS emotion, count(*) AS n FROM facts WHERE NOT list_has_any(regexp_extract_all(lower(content), '" + W + "'), ['" + "','".join(sorted({k for _, ks in EMOTIONS.values() for k in ks})) + "'])", FACTS))
def r03(spark, sf):
    return with_sentiment(facts(spark, sf), "content").where("emotion = 'neutral'").groupBy("emotion").agg(F.count("*").alias("n"))


PHRASES = (
    "what did we say yesterday", "today", "5 hours ago", "3 days ago", "2 weeks ago", "over the last 10 days", "last week", "this week", "plans of last month", "this month", "last year", "in october 2025", "in march", "back in 2023", "nothing of time",
)


def _phrase_sql() -> str:
    months = "|".join(MONTHS)
    named = rf"\b({months})\b(?:\s+(\d{{4}}))?"
    of = "list_position([" + ", ".join(f"'{m}'" for m in MONTHS) + f"], regexp_extract(q, '{named}', 1))"
    first = f"make_date((CASE WHEN regexp_extract(q, '{named}', 2) <> '' THEN regexp_extract(q, '{named}', 2)::BIGINT ELSE year(ts) - ({of} > month(ts))::INT END)::BIGINT, {of}::BIGINT, 1)::TIMESTAMP"
    num = lambda p: f"regexp_extract(q, '{p}', 1)::INT"
    has = lambda p: f"regexp_extract(q, '{p}', 1) <> ''"
    h, d, w, p, y = r"(\d+)\s+hours?\s+ago", r"(\d+)\s+days?\s+ago", r"(\d+)\s+weeks?\s+ago", r"(?:last|past)\s+(\d+)\s+days?", r"\b((?:19|20)\d{2})\b"
    day, week, month, year = (f"date_trunc('{u}', ts)" for u in ("day", "week", "month", "year"))
    rules = (
        ("contains(q, 'yesterday')", f"{day} - INTERVAL 1 DAY", day), ("contains(q, 'today')", day, f"{day} + INTERVAL 1 DAY"),
        (has(h), f"ts - to_hours({num(h)}) - INTERVAL 30 MINUTE", f"ts - to_hours({num(h)}) + INTERVAL 30 MINUTE"), (has(d), f"ts - to_days({num(d)}) - INTERVAL 12 HOUR", f"ts - to_days({num(d)}) + INTERVAL 12 HOUR"),
        (has(w), f"{week} - to_days(7 * {num(w)})", f"{week} - to_days(7 * {num(w)}) + INTERVAL 7 DAY"), (has(p), f"ts - to_days({num(p)})", "ts"),
        ("contains(q, 'last week')", f"{week} - INTERVAL 7 DAY", week), ("contains(q, 'this week')", week, f"{week} + INTERVAL 7 DAY"), ("contains(q, 'last month')", f"{month} - INTERVAL 1 MONTH", month),
        ("contains(q, 'this month')", month, f"{month} + INTERVAL 1 MONTH"), ("contains(q, 'last year')", f"{year} - INTERVAL 1 YEAR", year), (has(named), first, f"{first} + INTERVAL 1 MONTH"),
        (has(y), f"make_date({num(y)}::BIGINT, 1, 1)::TIMESTAMP", f"make_date({num(y)}::BIGINT + 1, 1, 1)::TIMESTAMP"),
    )
    case = lambda k: "CASE " + " ".join(f"WHEN {r[0]} THEN ({r[k]})::TIMESTAMP" for r in rules) + " END"
    listed = "[" + ", ".join(f"'{x}'" for x in PHRASES) + "]"
    return f"SELECT id, {case(1)} AS begins, {case(2)} AS ends FROM (SELECT id, last_confirmed + to_seconds(id % 86400) AS ts, lower({listed}[id % {len(PHRASES)} + 1] || ' ' || content) AS q FROM facts)"


@query("x22_time_phrases", with_views(_phrase_sql(), FACTS))
def x22(spark, sf):
    """The range of times that each query means, a phrase before a message's text, each as of its own time."""
    f = facts(spark, sf)
    phrase = F.element_at(strings(PHRASES), (F.col("id") % len(PHRASES) + 1).cast("int"))
    asked = f.select("id", F.timestamp_add("SECOND", (F.col("id") % 86400).cast("int"), F.col("last_confirmed")).alias("at"), F.concat(phrase, F.lit(" "), F.col("content")).alias("q"))
    begin, end = time_range(F.col("q"), F.col("at"))
    return asked.select("id", begin.alias("begins"), end.alias("ends"))
