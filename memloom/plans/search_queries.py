"""Queries over search, likeness, scores, texts, graphs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from memloom.functions import fixed, rules
from memloom.functions import scoring as sc
from memloom.functions.sentiment import with_sentiment, with_topic
from memloom.functions.text import jaccard, terms, words
from memloom.operators import analytics, blocks, graph, nearest, pairs, search, stores, windows
from memloom.plans.catalog import ORACLE_SQL, query
from memloom.plans.indexes import text_index
from memloom.plans.recall import budgeted_recall
from memloom.plans.views import EPISODES, FACTS, FEEDBACK, LINKS, STATED_FACTS, as_of, episodes, facts, feedback, links, stated_facts, table, with_views

W = r"[\p{L}\p{N}_]+"
STOPS = "stops AS (SELECT ['" + "','".join(fixed.STOP_WORDS) + "'] AS stop)"
TF = f"tf AS (SELECT id, w AS term, count(*) AS tf FROM (SELECT id, unnest(regexp_extract_all(lower(content), '{W}')) AS w FROM facts) WHERE length(w) >= 2 AND NOT list_contains((SELECT stop FROM stops), w) GROUP BY ALL)"
HOURS = "(date_diff('second', last_confirmed, TIMESTAMP '2024-02-01') / 3600.0::DOUBLE)"


def r6(c):
    return F.round(c, 6)


def _age():
    return sc.hours_between(F.col("last_confirmed"), as_of())


def _case(value: str, table_: dict) -> str:
    return "CASE " + " ".join(f"WHEN {k} THEN {v}" for k, v in table_.items()) + f" ELSE {value} END"


BM25 = """asked(prefix) AS (VALUES {prefixes}), sized AS (SELECT id, regexp_extract_all(lower(content), '""" + W + """') AS w FROM facts),
hits AS (SELECT id, prefix, count(*) AS tf, any_value(n) AS len FROM (SELECT id, unnest(w) AS word, len(w) AS n FROM sized), asked WHERE starts_with(word, prefix) GROUP BY id, prefix),
scored AS (SELECT id, sum(greatest(1e-6, ln(((SELECT count(*) FROM sized) - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / (SELECT avg(len(w)) FROM sized)))) AS score
  FROM hits JOIN (SELECT prefix, count(*) AS df FROM hits GROUP BY prefix) USING (prefix) GROUP BY id)"""


@query("q01_bm25", with_views("SELECT id, round(score, 6)::DOUBLE AS score FROM scored", FACTS, BM25.replace('{prefixes}', "('sch'), ('then'), ('ment')")))
def q01(spark, sf):
    return text_index(spark, sf).bm25(["sch", "then", "ment"]).select("id", r6(F.col("score")).alias("score"))


FRESH = f"""greatest(0, least(1, importance * pow(0.5, {HOURS} / (672.0 * (1 + importance * 2) * (1 + 0.5 * ln(1 + confirmation_count)) * (1 + 1.5 * 0.3) * (1 + 0.2 * (confirmation_count - 1)))) + 0.1))
  * greatest(0.1, least(1, exp(-0.01 * ({HOURS} / 24) / (1 + 0.5 * (confirmation_count - 1)))))"""


@query("q05_budgeted_recall", with_views(f"""SELECT id, score, used, content FROM (SELECT id, score, content, sum(len(list_filter(string_split_regex(content, '\\s+'), lambda w: w <> ''))) OVER (ORDER BY score DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS used
  FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(content)) ORDER BY score DESC, id) AS n FROM (
    SELECT f.id, f.content, round({FRESH} * CASE WHEN category = 'creative' THEN 1.3 ELSE 1.0 END * ln(1 + confirmation_count), 9)::DOUBLE AS score
    FROM facts f JOIN (SELECT id FROM scored ORDER BY round(score, 9) DESC, id LIMIT 50) h ON f.id = h.id WHERE NOT is_superseded)) WHERE n = 1) WHERE used <= 1000""", FACTS, BM25.replace('{prefixes}', "('hero'), ('th'), ('en'), ('champion'), ('warrior')")))
def q05(spark, sf):
    return budgeted_recall(spark, facts(spark, sf), "hero th en", "creative", 1000, index=text_index(spark, sf))


@query("t01_exact_knn", """SELECT query, place, vec_id, round(score, 6)::DOUBLE AS score FROM (SELECT q.vec_id AS query, v.vec_id, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) DESC, v.vec_id) AS place FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0) WHERE place <= 10""")
def t01(spark, sf):
    v = table(spark, sf, "embeddings")
    return nearest.cosine_top(v, v.where("vec_id % 100 = 0"), 10).select("query", F.col("place").cast("long").alias("place"), "vec_id", r6(F.col("score")).alias("score"))


@query("t04_mmr")
def t04(spark, sf):
    v = table(spark, sf, "embeddings")
    near = nearest.cosine_top(v, v.where("vec_id % 100 = 0"), 30).join(v.select("vec_id", "embedding"), "vec_id")
    return search.mmr(near.select("query", F.col("vec_id").alias("id"), "score", F.col("embedding").alias("vector")), "query", 10)


KNOWN = "known(term, synonym) AS (VALUES " + ", ".join(f"('{t}', '{s}')" for g in fixed.SYNONYMS for t in g for s in g if s != t) + ")"
ASKED = ("dragon", "tea", "magic hero", "the serpent and the void", "flood", "a quest of fate", "boat")
_ASKED_SQL = "asked AS (SELECT conv_id * 1000 + turn AS id, ['" + "', '".join(ASKED) + f"'][(conv_id + turn) % {len(ASKED)} + 1] AS q FROM conversations)"


def _asked(spark, sf):
    """A query for each message, of a few kinds."""
    k = F.col("conv_id") + F.col("turn")
    return table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.element_at(F.array(*map(F.lit, ASKED)), (k % len(ASKED) + 1).cast("int")).alias("q"))


@query("j18_synonyms", f"WITH {_ASKED_SQL}, {KNOWN} SELECT id, term, synonym FROM (SELECT DISTINCT id, unnest(regexp_extract_all(lower(q), '{W}')) AS term FROM asked) JOIN known USING (term)")
def j18(spark, sf):
    known = spark.createDataFrame([(t, s) for g in fixed.SYNONYMS for t in g for s in g if s != t], "term string, synonym string")
    terms_ = _asked(spark, sf).select("id", F.explode(F.array_distinct(words(F.col("q")))).alias("term"))
    return terms_.join(F.broadcast(known), "term").select("id", "term", "synonym")  # a list in the code


@query("q09_expansion", f"""WITH {_ASKED_SQL}, {KNOWN}, t AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(q), '{W}')) AS term FROM asked)
  SELECT id, term, synonym, n FROM (SELECT t.id, t.term, synonym, row_number() OVER (PARTITION BY t.id, t.term ORDER BY synonym) AS n FROM t JOIN known USING (term) WHERE NOT EXISTS (SELECT 1 FROM t o WHERE o.id = t.id AND o.term = synonym)) WHERE n <= 3""")
def q09(spark, sf):
    """Each query's words with at most three synonyms, in code-point order; what the query itself holds is none."""
    return search.expansions(_asked(spark, sf), "id", "q").withColumn("n", F.col("n").cast("long"))


@query("a31_idf", with_views("SELECT term, df, round(ln(((SELECT count(*) FROM facts) + 1) / (df + 1)) + 1, 6)::DOUBLE AS idf FROM (SELECT term, count(DISTINCT id) AS df FROM tf GROUP BY term)", FACTS, STOPS, TF))
def a31(spark, sf):
    return analytics.idf(facts(spark, sf), "content").select("term", "df", r6(F.col("idf")).alias("idf"))


@query("a09_topic_report", with_views(f"""SELECT s.topic, n, first_seen, last_seen, round(importance, 6) AS importance, keywords FROM (SELECT topic, count(*) AS n, min(started_at) AS first_seen, max(started_at) AS last_seen, avg(importance) AS importance FROM episodes GROUP BY topic) s
  LEFT JOIN (SELECT topic, string_agg(term, ',' ORDER BY r) AS keywords FROM (SELECT topic, term, row_number() OVER (PARTITION BY topic ORDER BY count(*) DESC, term) AS r FROM (SELECT topic, unnest(regexp_extract_all(lower(summary), '{W}')) AS term FROM episodes)
    WHERE length(term) >= 2 AND NOT list_contains((SELECT stop FROM stops), term) GROUP BY topic, term) WHERE r <= 5 GROUP BY topic) k ON s.topic = k.topic""", EPISODES, STOPS))
def a09(spark, sf):
    return analytics.topic_report(episodes(spark, sf)).withColumn("importance", r6(F.col("importance")))


@query("d01_similar_pairs", with_views("""SELECT a, b, round(similarity, 6)::DOUBLE AS similarity FROM (SELECT x.a, x.b, dot / sqrt((sa + c * (na.n - sa)) * (sb + c * (nb.n - sb))) AS similarity FROM
  (SELECT p.id AS a, q.id AS b, sum(p.tf * q.tf) AS dot, sum(p.tf * p.tf) AS sa, sum(q.tf * q.tf) AS sb FROM tf p JOIN tf q ON p.term = q.term AND p.id < q.id GROUP BY 1, 2) x
  JOIN (SELECT id, sum(tf * tf) AS n FROM tf GROUP BY id) na ON na.id = a JOIN (SELECT id, sum(tf * tf) AS n FROM tf GROUP BY id) nb ON nb.id = b, (SELECT pow(1 + ln(1.5), 2) AS c)) WHERE similarity > 0.5""", FACTS, STOPS, TF))
def d01(spark, sf):
    return pairs.similar_pairs(facts(spark, sf), "id", "content", 0.5).select("a", "b", r6(F.col("similarity")).alias("similarity"))


@query("d04_fact_duplicates", with_views("""SELECT a, b, round(least(1.0, 0.7 * greatest(s, CASE WHEN st THEN 0.3 ELSE 0 END, CASE WHEN ss THEN 0.5 ELSE 0 END) + 0.3 * (s + CASE WHEN st THEN 0.3 ELSE 0 END + CASE WHEN ss THEN 0.5 ELSE 0 END) / (1 + st::INT + ss::INT)), 6)::DOUBLE AS score FROM (
  SELECT a, b, similarity AS s, f.fact_type = g.fact_type AS st, f.source_episode = g.source_episode AS ss FROM (SELECT x.a, x.b, dot / sqrt((sa + c * (na.n - sa)) * (sb + c * (nb.n - sb))) AS similarity FROM
  (SELECT p.id AS a, q.id AS b, sum(p.tf * q.tf) AS dot, sum(p.tf * p.tf) AS sa, sum(q.tf * q.tf) AS sb FROM tf p JOIN tf q ON p.term = q.term AND p.id < q.id GROUP BY 1, 2) x
  JOIN (SELECT id, sum(tf * tf) AS n FROM tf GROUP BY id) na ON na.id = a JOIN (SELECT id, sum(tf * tf) AS n FROM tf GROUP BY id) nb ON nb.id = b, (SELECT pow(1 + ln(1.5), 2) AS c)) p
  JOIN facts f ON f.id = a JOIN facts g ON g.id = b WHERE similarity > 0.5)""", FACTS, STOPS, TF))
def d04(spark, sf):
    return fact_duplicates(facts(spark, sf))


def fact_duplicates(f):
    """Signals: content above 0.5, 0.3 for an equal type, 0.5 for the shared source; 0.7 of the greatest and 0.3 of their mean."""
    side = lambda k: f.select(F.col("id").alias(k), F.col("fact_type").alias(f"t{k}"), F.col("source_episode").alias(f"s{k}"))
    p = pairs.similar_pairs(f, "id", "content", 0.5).join(side("a"), "a").join(side("b"), "b")
    signals = F.array_compact(F.array(F.col("similarity"), F.when(F.col("ta") == F.col("tb"), 0.3), F.when(F.col("sa") == F.col("sb"), 0.5)))
    mean = F.aggregate(signals, F.lit(0.0), lambda s, x: s + x) / F.size(signals)
    return p.select("a", "b", r6(F.least(F.lit(1.0), 0.7 * F.array_max(signals) + 0.3 * mean)).alias("score"))


@query("d05_keep_quality", with_views("""SELECT id, round(CASE WHEN length(content) BETWEEN 30 AND 200 THEN 2.0 WHEN length(content) > 200 THEN 1.0 ELSE 0.5 END + 3 * confidence + 2 * ln(1 + confirmation_count) + least(1.0, 0.2 * len(tags)) + 1.5 * importance - CASE WHEN is_superseded THEN 5.0 ELSE 0 END, 6)::DOUBLE AS quality FROM facts""", FACTS))
def d05(spark, sf):
    q = sc.keeper_quality(F.col("content"), F.col("confidence"), F.col("confirmation_count"), F.col("importance"), F.size("tags"), F.col("is_superseded"))
    return facts(spark, sf).select("id", r6(q).alias("quality"))


@query("k01_adaptive_decay", with_views(f"""SELECT id, round(greatest(0, least(1, importance * pow(0.5, {HOURS} / half) + 0.02)), 6)::DOUBLE AS strength,
  round(CASE WHEN importance <= 0 THEN 0 ELSE greatest(0, half * log2(importance / 0.08) - {HOURS}) END, 3)::DOUBLE AS hours_left
  FROM (SELECT *, 168.0::DOUBLE * (1 + importance * 2) * (1 + 0.5 * ln(1 + access_count)) * (1 + 1.5 * 0.3) * (1 + 0.2 * (confirmation_count - 1)) AS half FROM facts WHERE importance > 0
  UNION ALL SELECT *, 1.0 FROM facts WHERE importance <= 0)""", FACTS))
def k01(spark, sf):
    args = (_age(), F.col("importance"), F.col("access_count"), F.lit(0.3), F.col("confirmation_count") - 1)
    return facts(spark, sf).select("id", r6(sc.adaptive_strength(*args)).alias("strength"), F.round(sc.hours_until(0.1, *args), 3).alias("hours_left"))


@query("k02_base_strength", with_views(f"SELECT id, round(greatest(0, least(1, importance * pow(0.5, {HOURS} * 0.1 / 24) + 0.1 * ln(1 + access_count))), 6)::DOUBLE AS strength FROM facts", FACTS))
def k02(spark, sf):
    return facts(spark, sf).select("id", r6(sc.base_strength(_age(), F.col("importance"), F.col("access_count"))).alias("strength"))


@query("k03_retrieval_decay", with_views(f"SELECT id, round(greatest(0.1, exp(-0.01 / (1 + 0.5 * ln(1 + confirmation_count)) * ({HOURS} / 24))), 6)::DOUBLE AS decay FROM facts", FACTS))
def k03(spark, sf):
    return facts(spark, sf).select("id", r6(sc.fact_decay(_age() / 24, F.col("confirmation_count"))).alias("decay"))


@query("k03_episode_decay", with_views("SELECT id, round(greatest(0.02, exp(-0.099 / (1 + 1.5 * abs(valence)) / (1 + 0.5 * ln(1 + access_count)) * (date_diff('second', started_at, TIMESTAMP '2024-02-01') / 86400.0))), 6)::DOUBLE AS decay FROM episodes", EPISODES))
def k03e(spark, sf):
    days = sc.hours_between(F.col("started_at"), as_of()) / 24
    return episodes(spark, sf).select("id", r6(sc.episode_decay(days, F.col("valence"), F.col("access_count"))).alias("decay"))


@query("k04_fact_freshness", with_views(f"SELECT id, round({FRESH}, 6)::DOUBLE AS freshness FROM facts", FACTS))
def k04(spark, sf):
    return facts(spark, sf).select("id", r6(sc.fact_freshness(_age(), F.col("importance"), F.col("confirmation_count"))).alias("freshness"))


@query("k06_forgetting_cycle", with_views(f"""SELECT action, count(*) AS n FROM (SELECT CASE WHEN confidence >= 0.9 THEN 'protected' WHEN confidence * (1 - {HOURS} / 720) < 0.05 THEN 'collected' ELSE 'decayed' END AS action FROM facts) GROUP BY action""", FACTS))
def k06(spark, sf):
    action = F.when(F.col("confidence") >= 0.9, "protected").when(F.col("confidence") * (1 - _age() / 720) < 0.05, "collected").otherwise("decayed")
    return facts(spark, sf).groupBy(action.alias("action")).agg(F.count("*").alias("n"))


@query("k07_episode_health", with_views("""SELECT CASE WHEN s >= 0.7 THEN 'protected' WHEN s < 0.05 THEN 'gone' WHEN s < 0.2 THEN 'weak' ELSE 'fading' END AS health, count(*) AS n FROM (
  SELECT greatest(0, least(1, importance * pow(0.5, date_diff('second', started_at, TIMESTAMP '2024-02-01') / 3600.0 / (168.0 * (1 + importance * 2) * (1 + 0.5 * ln(1 + access_count)) * (1 + 1.5 * abs(valence) / 2.0))) + 0.02)) AS s FROM episodes) GROUP BY 1""", EPISODES))
def k07(spark, sf):
    s = sc.adaptive_strength(sc.hours_between(F.col("started_at"), as_of()), F.col("importance"), F.col("access_count"), F.abs("valence") / 2.0, F.lit(0))
    health = F.when(s >= 0.7, "protected").when(s < 0.05, "gone").when(s < 0.2, "weak").otherwise("fading")
    return episodes(spark, sf).groupBy(health.alias("health")).agg(F.count("*").alias("n"))


@query("k08_importance_score", with_views(f"SELECT id, round(greatest(0, least(1, 0.3 * importance * confidence + 0.25 * least(1, log2(access_count + 1) / 5) + 0.2 * pow(0.5, {HOURS} / 24 / 14) + 0.15 * 0.5 + 0.1 * least(1, ln(1 + confirmation_count) / 3))), 6)::DOUBLE AS score FROM facts", FACTS))
def k08(spark, sf):
    score = sc.importance_score(F.col("importance") * F.col("confidence"), F.col("access_count"), _age() / 24, F.lit(0.5), F.least(F.lit(1.0), F.log1p("confirmation_count") / 3))
    return facts(spark, sf).select("id", r6(score).alias("score"))


_SAMPLES = [(1, "I live in Vancouver and I work at DataForge"), (2, "I'm debugging the def parser {}"), (3, "what is this?"), (4, "i have a question about Python"), (5, "My name is Ada Lovelace and I study Mathematics in London since 1833")]
_SAMPLE_SQL = "samples(id, content) AS (VALUES " + ", ".join(f"({i}, '{t.replace(chr(39), chr(39) * 2)}')" for i, t in _SAMPLES) + ")"


def _any(column: str, needles) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(column, n.replace("'", "''")) for n in needles) + ")"


def _with_samples(spark, sf):
    """The facts and a few statements in English, which the test texts lack."""
    return facts(spark, sf).select("id", "content").unionByName(spark.createDataFrame([(-i, t) for i, t in _SAMPLES], "id long, content string"))


BOTH = "both_ AS (SELECT id, content FROM facts UNION ALL SELECT -id, content FROM samples)"


QUALITY = f"""greatest(0, least(1, 0.5 + CASE WHEN {_any('lower(content)', fixed.HIGH_VALUE)} THEN 0.25 ELSE 0 END - CASE WHEN {_any('lower(content)', fixed.TRANSIENT)} THEN 0.3 ELSE 0 END
  - CASE WHEN {_any('content', fixed.CODE_LIKE)} THEN 0.2 ELSE 0 END - CASE WHEN ends_with(rtrim(content), '?') THEN 0.3 ELSE 0 END
  + CASE WHEN len(list_filter(string_split_regex(regexp_replace(content, '^\\s*\\S+', ''), '\\s+'), lambda w: regexp_matches(w, '^\\p{{Lu}}\\p{{L}}*$'))) > 0 THEN 0.1 ELSE 0 END
  - CASE WHEN {_any('lower(content)', fixed.GENERIC)} THEN 0.2 ELSE 0 END + CASE WHEN length(content) BETWEEN 30 AND 150 THEN 0.05 WHEN length(content) > 300 THEN -0.1 ELSE 0 END))"""


@query("k09_text_quality", with_views(f"SELECT id, round({QUALITY}, 6)::DOUBLE AS quality FROM both_", FACTS, _SAMPLE_SQL, BOTH))
def k09(spark, sf):
    return _with_samples(spark, sf).select("id", r6(sc.fact_text_quality(F.col("content"))).alias("quality"))


@query("k10_quality_levels", with_views("SELECT CASE WHEN q >= 0.8 THEN 'excellent' WHEN q >= 0.6 THEN 'good' WHEN q >= 0.4 THEN 'fair' WHEN q >= 0.2 THEN 'poor' ELSE 'critical' END AS level, count(*) AS n FROM (SELECT round(0.55 * confidence + 0.45 * importance, 9) AS q FROM facts) GROUP BY 1", FACTS))
def k10(spark, sf):
    q = F.round(0.55 * F.col("confidence") + 0.45 * F.col("importance"), 9)
    return facts(spark, sf).groupBy(sc.level(q).alias("level")).agg(F.count("*").alias("n"))


@query("k11_context_confidence", with_views("""SELECT id, round(c, 6)::DOUBLE AS confidence, CASE WHEN round(c, 9) >= 0.7 THEN 'high' WHEN round(c, 9) >= 0.4 THEN 'medium' ELSE 'low' END AS gate FROM (SELECT id, greatest(0, least(1, confidence * CASE WHEN category = 'creative' AND id % 5 = 0 THEN 1.1 WHEN category = 'creative' THEN 0.3 WHEN category = 'general' THEN 0.9 ELSE 1.0 END
  * CASE WHEN id % 7 = 0 AND id % 5 <> 0 THEN 0.6 ELSE 1.0 END * CASE WHEN is_superseded THEN 0.7 ELSE 1.0 END + 0.05 * confirmation_count)) AS c FROM facts)""", FACTS))
def k11(spark, sf):
    context = F.when(F.col("category") == "creative", "fiction").when(F.col("category") == "general", "uncertain").otherwise("reality")
    c = sc.context_confidence(F.col("confidence"), context, F.col("id") % 7 == 0, F.col("is_superseded"), F.col("confirmation_count"), F.col("id") % 5 == 0)
    return facts(spark, sf).select("id", r6(c).alias("confidence"), sc.gate(F.round(c, 9)).alias("gate"))


@query("k12_consolidation_importance", with_views("SELECT id, round(least(1, 0.3 + least(0.2, 0.05 * ln(1 + n_messages)) + CASE WHEN id % 2 = 0 THEN 0.2 ELSE 0 END + CASE WHEN valence <> 0 THEN 0.1 ELSE 0 END + 0.2 * abs(valence) / 2.0), 6)::DOUBLE AS importance FROM episodes", EPISODES))
def k12(spark, sf):
    score = sc.consolidation_importance(F.col("n_messages"), F.col("id") % 2 == 0, F.col("valence") != 0, F.abs("valence") / 2.0)
    return episodes(spark, sf).select("id", r6(score).alias("importance"))


@query("x01_tokenizer", with_views("SELECT f.id, coalesce(n, 0) AS n_terms, first_term FROM facts f LEFT JOIN (SELECT id, sum(tf)::BIGINT AS n FROM tf GROUP BY id) t ON t.id = f.id LEFT JOIN (SELECT id, arg_min(w, i) AS first_term FROM (SELECT id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT id, regexp_extract_all(lower(content), '" + W + "') AS ws FROM facts)) WHERE length(w) >= 2 AND NOT list_contains((SELECT stop FROM stops), w) GROUP BY id) x ON x.id = f.id", FACTS, STOPS, TF))
def x01(spark, sf):
    t = terms(F.col("content"))
    return facts(spark, sf).select("id", F.size(t).cast("long").alias("n_terms"), F.get(t, F.lit(0)).alias("first_term"))


@query("x03_reply_jaccard", f"""SELECT conv_id, turn, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6)::DOUBLE AS likeness FROM (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '{W}')) AS a,
  list_distinct(regexp_extract_all(lower(lag(text) OVER (PARTITION BY conv_id ORDER BY turn)), '{W}')) AS b FROM conversations) WHERE b IS NOT NULL""")
def x03(spark, sf):
    from pyspark.sql.window import Window

    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    c = table(spark, sf, "conversations").withColumn("_before", before).where("_before is not null")
    return c.select("conv_id", "turn", r6(jaccard(words(F.col("text")), words(F.col("_before")))).alias("likeness"))


def _count(keys) -> str:
    return "len(list_intersect(w, ['" + "','".join(keys) + "']))"


@query("x04_topic_category", with_views(f"""SELECT id, CASE WHEN greatest(a, b, c, d) = 0 THEN 'general' WHEN a >= greatest(b, c, d) THEN 'technical' WHEN b >= greatest(c, d) THEN 'creative' WHEN c >= d THEN 'personal' ELSE 'general' END AS category FROM (
  SELECT id, {_count(fixed.TOPICS['technical'])} AS a, {_count(fixed.TOPICS['creative'])} AS b, {_count(fixed.TOPICS['personal'])} AS c, {_count(fixed.TOPICS['general'])} AS d FROM (SELECT id, list_distinct(regexp_extract_all(lower(content), '{W}')) AS w FROM both_))""", FACTS, _SAMPLE_SQL, BOTH))
def x04(spark, sf):
    return with_topic(_with_samples(spark, sf), "content").select("id", "category")


@query("x15_sentiment", with_views("SELECT id, emotion, matches, round(s * least(matches / 5.0, 1.0) * CASE WHEN neg THEN -0.7 ELSE 1.0 END, 6)::DOUBLE AS sentiment FROM (SELECT id, neg, m AS matches, CASE WHEN m = 0 THEN 'neutral' " + " ".join(f"WHEN c{i} = m THEN '{n}'" for i, n in enumerate(fixed.EMOTIONS)) + " END AS emotion, CASE WHEN m = 0 THEN 0 " + " ".join(f"WHEN c{i} = m THEN {v}" for i, (v, _) in enumerate(fixed.EMOTIONS.values())) + " END AS s FROM (SELECT *, greatest(" + ", ".join(f"c{i}" for i in range(len(fixed.EMOTIONS))) + ") AS m FROM (SELECT id, list_has_any(w, ['" + "','".join(n for n in fixed.NEGATIONS if n.isalpha()) + "']) AS neg, " + ", ".join(f"{_count(k)} AS c{i}" for i, (_, k) in enumerate(fixed.EMOTIONS.values())) + f" FROM (SELECT id, list_distinct(regexp_extract_all(lower(content), '{W}')) AS w FROM both_))))", FACTS, "samples(id, content) AS (VALUES (11, 'I am very happy and grateful, a wonderful day'), (12, 'I am not happy'), (13, 'furious and mad'))", BOTH))
def x15(spark, sf):
    more = spark.createDataFrame([(-11, "I am very happy and grateful, a wonderful day"), (-12, "I am not happy"), (-13, "furious and mad")], "id long, content string")
    out = with_sentiment(facts(spark, sf).select("id", "content").unionByName(more), "content")
    return out.select("id", "emotion", "matches", r6(F.col("sentiment")).alias("sentiment"))


@query("x28_agent_detection", "SELECT ua, agent, count(*) AS n FROM (SELECT ua, CASE " + " ".join(f"WHEN regexp_matches(ua, '(?i){p}') THEN '{n}'" for p, n in fixed.USER_AGENTS) + " END AS agent FROM (SELECT ['Cursor/', 'python-requests/', 'Open-WebUI ', 'Mozilla/', 'continue.dev ', 'Blackreach-', 'python-httpx/'][event_id % 7 + 1] || (event_id % 3) AS ua FROM events)) GROUP BY ua, agent")
def x28(spark, sf):
    out = F.lit(None).cast("string")
    for pattern, name in reversed(fixed.USER_AGENTS):
        out = F.when(F.rlike("ua", F.lit(f"(?i){pattern}")), name).otherwise(out)
    kinds = F.array(*map(F.lit, ("Cursor/", "python-requests/", "Open-WebUI ", "Mozilla/", "continue.dev ", "Blackreach-", "python-httpx/")))
    agents = table(spark, sf, "events").select(F.concat(F.element_at(kinds, (F.col("event_id") % 7 + 1).cast("int")), (F.col("event_id") % 3).cast("string")).alias("ua"))
    return agents.select("ua", out.alias("agent")).groupBy("ua", "agent").agg(F.count("*").alias("n"))


@query("j04_feedback_join", with_views("SELECT f.id, coalesce(p, 0) AS positive, coalesce(n, 0) AS negative FROM facts f LEFT JOIN (SELECT fact_id, count(*) FILTER (is_positive) AS p, count(*) FILTER (NOT is_positive) AS n FROM feedback GROUP BY fact_id) x ON x.fact_id = f.id", FACTS, FEEDBACK))
def j04(spark, sf):
    marks = feedback(spark, sf).groupBy(F.col("fact_id").alias("id")).agg(F.count_if("is_positive").alias("p"), F.count_if(~F.col("is_positive")).alias("n"))
    return facts(spark, sf).join(marks, "id", "left").select("id", F.coalesce("p", F.lit(0)).alias("positive"), F.coalesce("n", F.lit(0)).alias("negative"))


@query("j11_orphan_links", with_views("SELECT source, target, kind FROM links WHERE target NOT IN (SELECT id FROM episodes WHERE id % 10 > 0) OR source NOT IN (SELECT id FROM episodes WHERE id % 10 > 0)", EPISODES, LINKS))
def j11(spark, sf):
    return graph.orphans(links(spark, sf), episodes(spark, sf).where("id % 10 > 0"), "id").select("source", "target", "kind")


@query("j13_fact_sources", with_views("SELECT f.id AS fact, e.id AS episode, e.topic FROM facts f JOIN episodes e ON f.source_episode = e.id", FACTS, EPISODES))
def j13(spark, sf):
    e = episodes(spark, sf).select(F.col("id").alias("episode"), "topic")
    return facts(spark, sf).select(F.col("id").alias("fact"), F.col("source_episode").alias("episode")).join(e, "episode").select("fact", "episode", "topic")


@query("j14_around_anchor", with_views("SELECT e.id, abs(date_diff('second', a.started_at, e.started_at)) AS seconds FROM episodes e, (SELECT * FROM episodes WHERE id = 3) a WHERE e.id <> a.id AND abs(date_diff('second', a.started_at, e.started_at)) <= 7 * 86400 ORDER BY 2, 1 LIMIT 10", EPISODES))
def j14(spark, sf):
    anchor = episodes(spark, sf).where("id = 3").select(F.col("started_at").alias("_at"))  # one row: the key is unique
    near = episodes(spark, sf).where("id <> 3").join(F.broadcast(anchor)).withColumn("seconds", F.abs(F.timestamp_diff("SECOND", F.col("_at"), F.col("started_at"))))
    return stores.page(near.where(F.col("seconds") <= 7 * 86_400), [F.asc("seconds"), F.asc("id")], 10).select("id", "seconds")


@query("j15_predecessors", with_views("SELECT id, previous, round(gap / 3600.0, 6)::DOUBLE AS gap_hours FROM (SELECT id, lag(id) OVER w AS previous, date_diff('second', lag(started_at) OVER w, started_at) AS gap FROM episodes WINDOW w AS (PARTITION BY topic ORDER BY started_at, id)) WHERE gap > 0 AND gap <= 168 * 3600", EPISODES))
def j15(spark, sf):
    return windows.predecessors(episodes(spark, sf), "id", "topic", "started_at", 168).select("id", "previous", r6(F.col("gap_hours")).alias("gap_hours"))


OVER = "len(list_intersect(a.w, b.w)) / greatest(1, len(list_distinct(list_concat(a.w, b.w))))"
WORDS = f"ws AS (SELECT id, fact_type, category, is_superseded, source_episode, list_distinct(regexp_extract_all(lower(content), '{W}')) AS w FROM facts)"


def _fact_pairs(spark, sf):
    """Pairs of facts of one conversation, the block in which relationships are sought; a conversation is a bounded group."""
    f = stated_facts(spark, sf).select("id", "fact_type", "category", "is_superseded", "source_episode", F.array_distinct(words(F.col("content"))).alias("w"))
    side = lambda k: f.select("source_episode", *(F.col(c).alias(f"{k}_{c}") for c in ("id", "fact_type", "category", "is_superseded", "w")))
    return side("a").join(side("b"), "source_episode").where("a_id < b_id")


@query("x11_contradictions", with_views(f"""SELECT a, b, round(least(1.0, score), 6)::DOUBLE AS confidence FROM (SELECT a.id AS a, b.id AS b, {OVER} AS o, a.category = b.category AS topic,
  CASE WHEN {OVER} >= 0.25 AND list_has_any(a.w, n) <> list_has_any(b.w, n) THEN 0.35 ELSE 0 END + CASE WHEN {' OR '.join(f"(list_contains(a.w, '{x}') AND list_contains(b.w, '{y}')) OR (list_contains(a.w, '{y}') AND list_contains(b.w, '{x}'))" for x, y in fixed.OPPOSITES)} THEN 0.35 ELSE 0 END
  + CASE WHEN a.fact_type = b.fact_type AND a.category = b.category THEN 0.15 ELSE 0 END + CASE WHEN (a.is_superseded OR b.is_superseded) AND {OVER} >= 0.2 THEN 0.2 ELSE 0 END AS score
  FROM ws a JOIN ws b ON a.source_episode = b.source_episode AND a.id < b.id, (SELECT ['{"','".join(n.replace("'", "''") for n in fixed.NEGATIONS)}'] AS n)) WHERE (o >= 0.15 OR topic) AND score >= 0.3""", STATED_FACTS, WORDS))
def x11(spark, sf):
    p = _fact_pairs(spark, sf)
    c = rules.contradiction(F.col("a_w"), F.col("b_w"), F.col("a_category") == F.col("b_category"), F.col("a_fact_type") == F.col("b_fact_type"), F.col("a_is_superseded") | F.col("b_is_superseded"))
    return p.withColumn("confidence", r6(c)).where("confidence is not null").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "confidence")


@query("x12_elaborations", with_views(f"""SELECT a, b, round(least(1.0, score), 6)::DOUBLE AS confidence FROM (SELECT a.id AS a, b.id AS b, {OVER} AS o,
  CASE WHEN least(len(a.w), len(b.w)) > 0 AND len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w)) >= 0.6 AND greatest(len(a.w), len(b.w)) / least(len(a.w), len(b.w)) >= 1.3 THEN 0.4 ELSE 0 END + CASE WHEN a.category = b.category THEN 0.2 ELSE 0 END
  + CASE WHEN a.fact_type = b.fact_type THEN 0.1 ELSE 0 END + CASE WHEN abs(len(a.w)::INT - len(b.w)::INT) / greatest(len(a.w), len(b.w), 1) > 0.3 THEN 0.15 ELSE 0 END AS score FROM ws a JOIN ws b ON a.source_episode = b.source_episode AND a.id < b.id) WHERE o >= 0.2 AND score >= 0.3""", STATED_FACTS, WORDS))
def x12(spark, sf):
    p = _fact_pairs(spark, sf)
    c = rules.elaboration(F.col("a_w"), F.col("b_w"), F.col("a_category") == F.col("b_category"), F.col("a_fact_type") == F.col("b_fact_type"))
    return p.withColumn("confidence", r6(c)).where("confidence is not null").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "confidence")


def _every(name: str) -> str:
    """The SQL of a rule over all pairs of facts, from that over the pairs of a conversation."""
    return ORACLE_SQL[name].replace("a.source_episode = b.source_episode AND a.id < b.id", "a.id < b.id")


CONTRADICTS, ELABORATES = 0, 1


def _related(spark, sf, *kinds):
    """Pairs of all facts by the rules of contradiction, elaboration or both, in one pass over blocks of all pairs (a, b, kind,
    confidence). A rule's parts are whole hundredths, looked at where the words are alike by 0.2 or opposites meet."""
    f = stated_facts(spark, sf)
    w = F.array_distinct(words(F.col("content")))
    holds = lambda side: sum((F.array_contains("w", p[side]).cast("long") * (1 << n) for n, p in enumerate(fixed.OPPOSITES)), F.lit(0).cast("long"))
    f = f.select("id", "is_superseded", F.xxhash64("category").alias("topic"), F.xxhash64("fact_type").alias("type"), w.alias("w"))
    f = f.select("id", blocks.hashed(F.col("w")).alias("h"), "topic", "type", "is_superseded", rules.negated(F.col("w")).alias("negated"), holds(0).alias("x"), holds(1).alias("y"))

    def rule(met):
        a, b = met.a, met.b
        (*_, ax, ay), (*_, bx, by) = a.extra, b.extra
        opposite = None
        ra, rb = np.flatnonzero(ax | ay), np.flatnonzero(bx | by)
        if CONTRADICTS in kinds and len(ra) and len(rb):
            opposite = np.zeros((len(a.ids), len(b.ids)), bool)
            opposite[np.ix_(ra, rb)] = (ax[ra][:, None] & by[rb] | ay[ra][:, None] & bx[rb]) != 0
        i, j, na, nb, shared, like = pairs.alike(met, 0.2, opposite)
        (topic, kind, old, no), (topic2, kind2, old2, no2) = (x.extra[:4, k] for x, k in ((a, i), (b, j)))
        topic, kind, small, large = topic == topic2, kind == kind2, np.minimum(na, nb), np.maximum(na, nb)
        found = []
        if CONTRADICTS in kinds:
            points = 35 * ((like >= 0.25) & (no != no2)) + 15 * (topic & kind) + 20 * ((old | old2).astype(bool) & (like >= 0.2))
            points += 0 if opposite is None else 35 * opposite[i, j]
            found.append((CONTRADICTS, points, (like >= 0.15) | topic))
        if ELABORATES in kinds:
            inside, ratio = (np.divide(x, small, out=np.zeros(len(small)), where=small > 0) for x in (shared, large))
            points = 40 * ((inside >= 0.6) & (ratio >= 1.3)) + 20 * topic + 10 * kind + 15 * ((large - small) / np.maximum(large, 1) > 0.3)
            found.append((ELABORATES, points, like >= 0.2))
        found = [(np.flatnonzero(gate & (points >= 30)), k, points) for k, points, gate in found]
        at = np.concatenate([ok for ok, _, _ in found])
        return i[at], j[at], [np.repeat(np.array([k for _, k, _ in found], np.int32), [len(ok) for ok, _, _ in found]), np.concatenate([np.minimum(100, points[ok]) / 100.0 for ok, _, points in found])]

    packed = blocks.pack(f, "h", ("topic", "type", "is_superseded", "negated", "x", "y"))
    return blocks.pairs(packed, rule, "kind int, confidence double").withColumn("confidence", r6(F.col("confidence")))


@query("x11_contradictions_of_all_facts", _every("x11_contradictions"))
def x11_all(spark, sf):
    """Contradictions among all facts. The rule's parts reach 0.3 only from a likeness of 0.2 on, but for words of opposite
    meaning: these count from 0.15 on or within a topic."""
    return _related(spark, sf, CONTRADICTS).drop("kind")


@query("x12_elaborations_of_all_facts", _every("x12_elaborations"))
def x12_all(spark, sf):
    """Elaborations among all facts: the rule asks for a likeness of 0.2."""
    return _related(spark, sf, ELABORATES).drop("kind")


@query("j07_relations_of_all_facts", f"SELECT a, b, 'contradicts' AS kind, confidence FROM ({_every('x11_contradictions')}) UNION ALL SELECT a, b, 'elaborates', confidence FROM ({_every('x12_elaborations')})")
def j07_all(spark, sf):
    """Pairs of facts of the whole table by both rules, each pair once for a kind, the lesser id first."""
    return _related(spark, sf, CONTRADICTS, ELABORATES).withColumn("kind", F.when(F.col("kind") == CONTRADICTS, "contradicts").otherwise("elaborates"))


@query("a03_link_kinds", with_views("SELECT kind, count(*) AS n, count(DISTINCT source) AS sources FROM links GROUP BY kind", LINKS))
def a03(spark, sf):
    return links(spark, sf).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"))


@query("a04_most_connected", with_views("SELECT node, count(*) AS degree FROM (SELECT source AS node FROM links UNION ALL SELECT target FROM links) GROUP BY node ORDER BY degree DESC, node LIMIT 10", LINKS))
def a04(spark, sf):
    return graph.link_stats(links(spark, sf))


@query("g02_links_both_ways", with_views("SELECT source, target, kind, weight FROM links WHERE weight >= 0.5 UNION ALL SELECT target, source, kind, weight FROM links WHERE weight >= 0.5", LINKS))
def g02(spark, sf):
    return graph.both_ways(links(spark, sf).where("weight >= 0.5")).select("source", "target", "kind", "weight")


EDGES = "e AS (SELECT DISTINCT source, target FROM (SELECT source, target, weight FROM links UNION ALL SELECT target, source, weight FROM links){})"


@query("g03_neighbourhood", with_views("SELECT node, min(hops) AS hops FROM walk GROUP BY node", LINKS, EDGES.format(" WHERE weight >= 0.3"), "RECURSIVE_walk").replace("WITH ", "WITH RECURSIVE ", 1).replace("RECURSIVE_walk", "walk AS (SELECT 4::BIGINT AS node, 0 AS hops UNION SELECT e.target, hops + 1 FROM walk JOIN e ON e.source = walk.node WHERE hops < 2)"))
def g03(spark, sf):
    return graph.neighbourhood(links(spark, sf), 4, 2)


@query("g05_shortest_path", with_views("SELECT node, array_to_string(path, '>') AS path FROM walk WHERE node = 75 ORDER BY len(path), path LIMIT 1", LINKS, EDGES.format(""), "RECURSIVE_walk").replace("WITH ", "WITH RECURSIVE ", 1).replace("RECURSIVE_walk", "walk AS (SELECT 4::BIGINT AS node, [4::BIGINT] AS path UNION ALL SELECT e.target, list_append(path, e.target) FROM walk JOIN e ON e.source = walk.node WHERE len(path) <= 5 AND NOT list_contains(path, e.target))"))
def g05(spark, sf):
    return graph.shortest_path(links(spark, sf), 4, 75).select("node", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query("g08_property_graph", with_views("""SELECT source, target, kind FROM (SELECT 'episode:' || id AS source, 'topic:' || topic AS target, 'about' AS kind FROM episodes UNION ALL
  SELECT 'episode:' || source_episode, 'fact:' || f.id, 'source_of' FROM facts f WHERE source_episode IN (SELECT id FROM episodes) UNION ALL SELECT 'episode:' || source, 'episode:' || target, kind FROM links)""", FACTS, EPISODES, LINKS))
def g08(spark, sf):
    return graph.property_graph(episodes(spark, sf), facts(spark, sf), links(spark, sf))[1]


@query("g10_chains", with_views("SELECT node, min(other) AS chain FROM (SELECT source AS node, source AS other FROM e UNION SELECT node, other FROM walk) GROUP BY node", LINKS, EDGES.format(""), "RECURSIVE_walk").replace("WITH ", "WITH RECURSIVE ", 1).replace("RECURSIVE_walk", "walk AS (SELECT source AS node, target AS other FROM e UNION SELECT walk.node, e.target FROM walk JOIN e ON e.source = walk.other)"))
def g10(spark, sf):
    return graph.chains(spark, links(spark, sf))
