"""Text vectors and vector stores: hashed TF-IDF as sparse rows, exact search, merged text and vector hits.

A vector is a few rows (id, slot, weight), so likeness is a join on slots and nothing dense is ever collected.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.functions.text import terms
from memloom.operators import blocks
from memloom.operators.pairs import term_counts

SLOTS = 512
#: An embedder: rows (id, text) to sparse unit vectors (id, slot, weight). Any function of this form can take its place.
Embedder = Callable[[DataFrame, str, str], DataFrame]


def slot(term: Column, slots: int = SLOTS) -> Column:
    return (F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("long") % slots).cast("int")


def idf(counts: DataFrame, rows: DataFrame) -> DataFrame:
    """Of each term ln((N + 1) / (df + 1)) + 1."""
    n = rows.agg(F.count("*").alias("_n"))
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(n)).select("term", (F.log((F.col("_n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))  # n is one row


def unit(weights: DataFrame) -> DataFrame:
    norms = weights.groupBy("id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_norm"))
    return weights.join(norms, "id").where("_norm > 0").select("id", "slot", (F.col("weight") / F.col("_norm")).alias("weight"))


def tfidf(rows: DataFrame, key: str, text: str, corpus: DataFrame | None = None) -> DataFrame:
    """The default embedder: TF-IDF of terms, hashed to SLOTS slots, of length 1. corpus: term weights come from these rows
    (key, text) instead, as for a query's text. Rows without a known term have no vector."""
    counts = term_counts(rows, key, text)
    known = idf(counts, rows) if corpus is None else idf(term_counts(corpus, key, text), corpus)
    return unit(counts.join(known, "term").groupBy("id", slot(F.col("term")).alias("slot")).agg(F.sum(F.col("tf") * F.col("idf")).alias("weight")))


def dense(vectors: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Sparse vectors as arrays: one row holds at most `slots` values."""
    filled = F.map_from_entries(F.collect_list(F.struct("slot", "weight")))
    return vectors.groupBy("id").agg(filled.alias("_m")).select("id", F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda i: F.coalesce(F.col("_m")[i], F.lit(0.0))).alias("vector"))


def likeness(left: DataFrame, right: DataFrame) -> DataFrame:
    """Cosine of every pair (a of left, b of right) that shares a slot."""
    a = left.select(F.col("id").alias("a"), "slot", F.col("weight").alias("_wa"))
    b = right.select(F.col("id").alias("b"), "slot", F.col("weight").alias("_wb"))
    return a.join(b, "slot").groupBy("a", "b").agg(F.sum(F.col("_wa") * F.col("_wb")).alias("cosine"))


def similar(vectors: DataFrame, threshold: float) -> DataFrame:
    """Pairs a < b of unit vectors whose cosine reaches the threshold. If the slots that a pair shares all lay behind a vector's
    prefix (rare slots first, until the rest is shorter than the threshold), its cosine would be less; so prefixes meet alone."""
    from pyspark.sql.window import Window

    ranked = vectors.join(vectors.groupBy("slot").agg(F.count("*").alias("df")), "slot")
    rest = F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("id").orderBy(F.desc("df"), F.desc("slot")).rowsBetween(Window.unboundedPreceding, 0))
    prefix = ranked.withColumn("_rest", rest).where((F.col("_rest") >= threshold * threshold - 1e-9) & (F.col("df") > 1)).select("id", "slot")
    found = prefix.select(F.col("id").alias("a"), "slot").join(prefix.select(F.col("id").alias("b"), "slot"), "slot").where("a < b").select("a", "b").distinct()
    side = lambda k: vectors.select(F.col("id").alias(k), "slot", F.col("weight").alias(f"_w{k}"))
    both = found.join(side("a"), "a").join(side("b"), ["b", "slot"]).groupBy("a", "b").agg(F.sum(F.col("_wa") * F.col("_wb")).alias("cosine"))
    return both.where(F.round("cosine", 9) >= threshold)


def similar_texts(rows: DataFrame, key: str, text: str, threshold: float, but: str | None = None) -> DataFrame:
    """Pairs a < b of texts whose vectors by `tfidf` have a cosine of the threshold or more, from blocks of all pairs. but: a
    boolean column; such rows count in the weights and are in no pair."""
    n = rows.count()
    keyed = rows.select(F.col(key).alias("id"), blocks.slotted(terms(F.col(text))).alias("_h"), F.col(but).alias("_but") if but else F.lit(False).alias("_but"))
    whole = keyed.groupBy("id").agg(F.flatten(F.collect_list("_h")).alias("_h"), F.max("_but").alias("_but"))
    packed = blocks.with_frequencies(blocks.pack(whole, "_h", ("_but",), head=0))

    def weighted(row: Sequence, of: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        weights = counts * (np.log((n + 1) / (blocks.frequency_of(row, keys) + 1)) + 1)
        at, which = np.unique(of * SLOTS + (keys >> 32 & 0xFFFFFFFF) % SLOTS, return_inverse=True)
        of, summed = at // SLOTS, np.bincount(which, weights, minlength=len(at))
        return of, at % SLOTS, summed / np.sqrt(np.bincount(of, summed * summed))[of]

    def rule(met: blocks.Meeting) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        a, b = met.a, met.b
        i, j = np.nonzero(a.head.astype(np.float32) @ b.head.astype(np.float32).T > threshold - 1e-4)
        ok = (a.extra[0][i] == 0) & (b.extra[0][j] == 0)
        i, j = i[ok], j[ok]
        cosine = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", a.head[i[k : k + 4096]], b.head[j[k : k + 4096]]) for k in range(0, len(i), 4096))])
        return i, j, [cosine]

    return blocks.pairs(packed._replace(head=np.arange(SLOTS)), rule, "cosine double", valued=weighted).where(F.round("cosine", 9) >= threshold)


def nearest(queries: DataFrame, store: DataFrame, k: int) -> DataFrame:
    """For each query (a few) the k stored vectors of greatest cosine: query, place, id, score."""
    from pyspark.sql.window import Window

    hits = likeness(queries, store).select(F.col("a").alias("query"), F.col("b").alias("id"), F.col("cosine").alias("score"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), F.asc("id")))
    return hits.withColumn("place", place).where(F.col("place") <= k).select("query", "place", "id", "score")


def distance_score(cosine: Column) -> Column:
    """One minus the distance; a distance of 0 scores 0, as nothing was measured."""
    return F.when(F.round(1 - cosine, 9) == 0, 0.0).otherwise(cosine)


def rank_score(place: Column, n: Column, inclusive: bool = True) -> Column:
    """Of place i (from 1) of n: 1 - (i - 1) / (n + 1), or / n."""
    return 1 - (place - 1) / (n + 1 if inclusive else n)


def merged(text_hits: DataFrame, vector_hits: DataFrame, text_weight: float, vector_weight: float, inclusive: bool = True) -> DataFrame:
    """Full outer merge of text hits (id, place) and vector hits (id, score); what one side lacks counts 0."""
    n = text_hits.agg(F.count("*").alias("_n"))
    t = text_hits.join(F.broadcast(n)).select("id", rank_score(F.col("place"), F.col("_n"), inclusive).alias("text_score"))  # n is one row
    both = t.join(vector_hits.select("id", F.col("score").alias("vector_score")), "id", "full_outer").fillna(0.0, ["text_score", "vector_score"])
    return both.withColumn("score", text_weight * F.col("text_score") + vector_weight * F.col("vector_score"))


def added(text_hits: DataFrame, vector_hits: DataFrame, rows: DataFrame, text_weight: float = 0.3, vector_weight: float = 0.7) -> DataFrame:
    """The same merge as an additive map of scores; then the rows of the ids are fetched."""
    n = text_hits.agg(F.count("*").alias("_n"))
    t = text_hits.join(F.broadcast(n)).select("id", (text_weight * rank_score(F.col("place"), F.col("_n"), False)).alias("score"))
    v = vector_hits.select("id", (vector_weight * F.col("score")).alias("score"))
    return t.unionByName(v).groupBy("id").agg(F.sum("score").alias("score")).join(rows, "id")


def reranked(candidates: DataFrame, scorer: Callable[[Column, Column], Column], k: int) -> DataFrame:
    """The k best of each query's candidates (query, asked, id, content) by a scorer of (asked, content): any column function."""
    from pyspark.sql.window import Window

    scored = candidates.withColumn("score", scorer(F.col("asked"), F.col("content")))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), F.asc("id")))
    return scored.withColumn("place", place).where(F.col("place") <= k)
