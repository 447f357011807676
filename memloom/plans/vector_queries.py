"""Queries over text vectors: embedding, vector stores, hybrid search, reranking."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memloom.functions import scoring as sc
from memloom.functions.text import words
from memloom.operators import search, stores, vectors
from memloom.plans.catalog import ORACLE_SQL, query
from memloom.plans.indexes import cell_index, text_index, vector_index
from memloom.plans.search_queries import BM25, STOPS, TF, W, r6
from memloom.plans.views import EPISODES, FACTS, as_of, episodes, facts, table, with_views

ASKED = ("sch", "then", "ment")
BM = BM25.replace("{prefixes}", ", ".join(f"('{p}')" for p in ASKED))
IDF = "idf AS (SELECT term, ln(((SELECT count(*) FROM facts) + 1) / (count(*) + 1)) + 1 AS idf FROM tf GROUP BY term)"
SLOT = "('0x' || substr(md5(term), 1, 8))::BIGINT % 512"
VEC = f"vec AS (SELECT id, slot, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM (SELECT id, {SLOT} AS slot, sum(tf * idf) AS w FROM tf JOIN idf USING (term) GROUP BY 1, 2))"
TOLD = "first_text AS (SELECT content FROM facts WHERE len(list_filter(regexp_extract_all(lower(content), '" + W + "'), lambda w: length(w) >= 2)) >= 3 ORDER BY id LIMIT 1)"
LIMIT = 10


def _limited(hits, k):
    order = [F.desc(F.round("score", 9)), F.asc("id")]
    return hits.orderBy(*order).limit(k).withColumn("place", F.row_number().over(Window.orderBy(*order)))  # a top-k


@query("q11_text_vectors", with_views("SELECT id, slot, round(weight, 6)::DOUBLE AS weight FROM vec", FACTS, STOPS, TF, IDF, VEC))
def q11(spark, sf):
    return vectors.tfidf(facts(spark, sf), "id", "content").select("id", F.col("slot").cast("long").alias("slot"), r6(F.col("weight")).alias("weight"))


@query("q12_index_build", with_views("SELECT 'fact' AS kind, count(DISTINCT id) AS n_rows, count(*) AS n_entries, count(DISTINCT slot) AS n_slots, round(sum(weight * weight), 3)::DOUBLE AS mass FROM vec UNION ALL "
    + "SELECT 'episode', count(DISTINCT id), count(*), count(DISTINCT slot), round(sum(weight * weight), 3)::DOUBLE FROM vec2", FACTS, EPISODES, STOPS, TF, IDF, VEC,
    TF.replace("tf AS (", "tf2 AS (", 1).replace("FROM facts", "FROM (SELECT id, summary AS content FROM episodes)"),
    IDF.replace("idf AS (", "idf2 AS (", 1).replace("FROM facts", "FROM episodes").replace("FROM tf ", "FROM tf2 "), VEC.replace("vec AS (", "vec2 AS (", 1).replace("tf JOIN idf", "tf2 JOIN idf2")))
def q12(spark, sf):
    """The vectors of facts and episodes side by side, as an index holds them."""
    both = vectors.tfidf(facts(spark, sf), "id", "content").withColumn("kind", F.lit("fact")).unionByName(vectors.tfidf(episodes(spark, sf), "id", "summary").withColumn("kind", F.lit("episode")))
    return both.groupBy("kind").agg(F.count_distinct("id").alias("n_rows"), F.count("*").alias("n_entries"), F.count_distinct("slot").alias("n_slots"), F.round(F.sum(F.col("weight") * F.col("weight")), 3).alias("mass"))


def _vector_hits(spark, sf, k):
    """The facts whose vectors are nearest to the vector of the first fact's words, itself among them."""
    f = facts(spark, sf)
    asked = f.where(F.size(F.filter(words(F.col("content")), lambda w: F.length(w) >= 2)) >= 3).orderBy("id").limit(1)
    index = vector_index(spark, sf)
    return index.nearest(index.embed(asked, "id", "content"), k)


QVEC = "qvec AS (SELECT slot, w / sqrt(sum(w * w) OVER ()) AS weight FROM (SELECT " + SLOT + " AS slot, sum(n * idf) AS w FROM (SELECT w AS term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(content), '" + W + "')) AS w FROM first_text) WHERE length(w) >= 2 AND NOT list_contains((SELECT stop FROM stops), w) GROUP BY w) JOIN idf USING (term) GROUP BY 1))"
VHITS = "vhits AS (SELECT id, sum(vec.weight * qvec.weight) AS vs FROM vec JOIN qvec USING (slot) GROUP BY id)"
MERGED = """t AS (SELECT id, 1 - (row_number() OVER (ORDER BY round(score, 9) DESC, id) - 1) / ((SELECT least({k}, count(*)) FROM scored) + {one}) AS ts FROM scored ORDER BY round(score, 9) DESC, id LIMIT {k}),
v AS (SELECT id, vs FROM vhits ORDER BY round(vs, 9) DESC, id LIMIT {k})"""
VECTORS = (FACTS, STOPS, TF, IDF, VEC, TOLD, QVEC, VHITS, BM)


@query("t02_nearest_vectors", with_views("SELECT row_number() OVER (ORDER BY round(vs, 9) DESC, id) AS place, id, round(CASE WHEN round(1 - vs, 9) = 0 THEN 0 ELSE vs END, 6)::DOUBLE AS score FROM vhits QUALIFY place <= 25", *VECTORS[:-1]))
def t02(spark, sf):
    return _vector_hits(spark, sf, 25).select(F.col("place").cast("long").alias("place"), "id", r6(vectors.distance_score(F.col("score"))).alias("score"))


@query("t02_indexed_nearest", ORACLE_SQL["t01_exact_knn"])
def t02_indexed(spark, sf):
    """The nearest embeddings of each hundredth one through the cells of the stored index, exactly: the cells' radii are bounds."""
    index = cell_index(spark, sf)
    return index.search(table(spark, sf, "embeddings").where("vec_id % 100 = 0"), 10).select("query", F.col("place").cast("long").alias("place"), "vec_id", r6(F.col("score")).alias("score"))


@query("t02_approximate_nearest")
def t02_approximate(spark, sf):
    """The same from the cells of a few centers, as many as the index was tuned to visit."""
    index = cell_index(spark, sf)
    found = index.search(table(spark, sf, "embeddings").where("vec_id % 100 = 0"), 10, index.versions.entry()["meta"]["probes"])
    return found.select("query", F.col("place").cast("long").alias("place"), "vec_id", r6(F.col("score")).alias("score"))


@query("t03_vector_store", """SELECT label, count(*) AS n, sum(vec_id)::BIGINT AS ids, sum(new)::BIGINT AS replaced FROM (
  SELECT vec_id, label, 0 AS new FROM embeddings WHERE vec_id % 10 <> 3 AND vec_id % 7 <> 2 UNION ALL SELECT vec_id, 100 + label, 1 FROM embeddings WHERE vec_id % 10 = 3 AND vec_id % 7 <> 2) GROUP BY label""")
def t03(spark, sf):
    """A batch replaces vectors by id, then ids are deleted; what is left is counted by label."""
    store = table(spark, sf, "embeddings").select("vec_id", "label", "embedding").withColumn("new", F.lit(0))
    batch = store.where("vec_id % 10 = 3").withColumns({"label": F.col("label") + 100, "new": F.lit(1)})
    left = stores.delete(stores.upsert(store, batch, "vec_id"), store.where("vec_id % 7 = 2"), "vec_id")
    return left.groupBy("label").agg(F.count("*").alias("n"), F.sum("vec_id").alias("ids"), F.sum("new").alias("replaced"))


@query("j02_text_and_vector_hits", with_views("SELECT coalesce(t.id, v.id) AS id, round(coalesce(ts, 0), 6)::DOUBLE AS text_score, round(coalesce(vs, 0), 6)::DOUBLE AS vector_score, round(0.2 * coalesce(ts, 0) + 0.8 * coalesce(vs, 0), 6)::DOUBLE AS score FROM t FULL JOIN v ON t.id = v.id",
    *VECTORS, MERGED.format(k=2 * LIMIT, one="1.0")))
def j02(spark, sf):
    text = _limited(text_index(spark, sf).bm25(ASKED), 2 * LIMIT)
    out = vectors.merged(text, _vector_hits(spark, sf, 2 * LIMIT), 0.2, 0.8)
    return out.select("id", *(r6(F.col(c)).alias(c) for c in ("text_score", "vector_score", "score")))


DAYS = "(date_diff('second', last_confirmed, TIMESTAMP '2024-02-01') / 86400.0::DOUBLE)"


@query("q03_hybrid_merge", with_views(f"""SELECT m.id, round(s * greatest(0.1, exp(-0.01 / (1 + 0.5 * ln(1 + confirmation_count)) * {DAYS})), 6)::DOUBLE AS score
  FROM (SELECT coalesce(t.id, v.id) AS id, 0.2 * coalesce(ts, 0) + 0.8 * coalesce(vs, 0) AS s FROM t FULL JOIN v ON t.id = v.id) m JOIN facts f ON f.id = m.id""", *VECTORS, MERGED.format(k=2 * LIMIT, one="1.0")))
def q03(spark, sf):
    """Text and vector hits merged and faded by age; what diversification (q03_hybrid_diverse) chooses from."""
    return _decayed(spark, sf).select("id", r6(F.col("score")).alias("score"))


def _decayed(spark, sf):
    f = facts(spark, sf)
    text = _limited(text_index(spark, sf).bm25(ASKED), 2 * LIMIT)
    out = vectors.merged(text, _vector_hits(spark, sf, 2 * LIMIT), 0.2, 0.8)
    days = sc.hours_between(F.col("last_confirmed"), as_of()) / 24
    fade = F.greatest(F.lit(0.1), F.exp(-0.01 / (1 + 0.5 * F.log1p("confirmation_count")) * days))
    return out.join(f, "id").select("id", (F.col("score") * fade).alias("score"))


@query("q03_hybrid_diverse")
def q03_diverse(spark, sf):
    """The best LIMIT of the three times as many first candidates, chosen for score and difference."""
    pool = _limited(_decayed(spark, sf), 3 * LIMIT).select("id", "score")
    own = vectors.dense(vector_index(spark, sf).vectors().join(F.broadcast(pool.select("id")), "id"))  # a top-k
    return search.mmr(pool.join(own, "id").withColumn("query", F.lit(0)), "query", LIMIT).select("id", "place")


@query("q04_service_hybrid", with_views("SELECT f.id, content, round(s, 6)::DOUBLE AS score FROM (SELECT id, sum(s) AS s FROM (SELECT id, 0.3 * ts AS s FROM t UNION ALL SELECT id, 0.7 * vs FROM v) GROUP BY id) m JOIN facts f ON f.id = m.id ORDER BY round(s, 9) DESC, f.id LIMIT 10",
    *VECTORS, MERGED.format(k=LIMIT, one="0.0")))
def q04(spark, sf):
    return _limited(_added(spark, sf), 10).select("id", "content", r6(F.col("score")).alias("score"))


def _added(spark, sf):
    f = facts(spark, sf)
    return vectors.added(_limited(text_index(spark, sf).bm25(ASKED), LIMIT), _vector_hits(spark, sf, LIMIT), f.select("id", "content", "fact_type"))


@query("j03_added_scores", with_views("SELECT f.id, fact_type, round(s, 6)::DOUBLE AS score FROM (SELECT id, sum(s) AS s FROM (SELECT id, 0.3 * ts AS s FROM t UNION ALL SELECT id, 0.7 * vs FROM v) GROUP BY id) m JOIN facts f ON f.id = m.id", *VECTORS, MERGED.format(k=LIMIT, one="0.0")))
def j03(spark, sf):
    return _added(spark, sf).select("id", "fact_type", r6(F.col("score")).alias("score"))


def _shared_words(asked, content):
    """A scorer for reranking: the share of what is asked that the content holds."""
    a = F.array_distinct(words(asked))
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, words(content))) / F.size(a)).otherwise(0.0)


@query("t05_reranked", with_views(f"""SELECT query, place, id, round(score, 6)::DOUBLE AS score FROM (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS place FROM (
  SELECT q.id AS query, f.id, CASE WHEN len(qw) > 0 THEN len(list_intersect(qw, regexp_extract_all(lower(f.content), '{W}'))) / len(qw) ELSE 0 END AS score
  FROM (SELECT id, source_episode, list_distinct(regexp_extract_all(lower(content), '{W}')) AS qw FROM facts WHERE id % 10 = 0) q JOIN facts f ON f.source_episode = q.source_episode)) WHERE place <= 3""", FACTS))
def t05(spark, sf):
    """Candidates of each opening message are its conversation's messages."""
    f = facts(spark, sf)
    asked = f.where("id % 10 = 0").select(F.col("id").alias("query"), "source_episode", F.col("content").alias("asked"))
    out = vectors.reranked(asked.join(f.select("id", "source_episode", "content"), "source_episode"), _shared_words, 3)
    return out.select("query", F.col("place").cast("long").alias("place"), "id", r6(F.col("score")).alias("score"))


@query("r24_pair_likeness", with_views("SELECT a, b, round(cosine, 6)::DOUBLE AS cosine FROM (SELECT x.id AS a, y.id AS b, sum(x.weight * y.weight) AS cosine FROM vec x JOIN vec y USING (slot) WHERE y.id = x.id + 1 GROUP BY 1, 2)", FACTS, STOPS, TF, IDF, VEC))
def r24(spark, sf):
    """The likeness of each message's text and the next one's."""
    v = vectors.tfidf(facts(spark, sf), "id", "content")
    shifted = v.withColumn("id", F.col("id") - 1)
    pairs = v.alias("x").join(shifted.alias("y"), ["id", "slot"]).groupBy("id").agg(F.sum(F.col("x.weight") * F.col("y.weight")).alias("cosine"))
    return pairs.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), r6(F.col("cosine")).alias("cosine"))
