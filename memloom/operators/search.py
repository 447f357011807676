"""Full-text, vector and hybrid search over postings and vector tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memloom.functions.fixed import SYNONYMS
from memloom.functions.text import words

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def expanded(query: Sequence[str], per_term: int = 3, most: int = 10) -> list[str]:
    """The query's words, then synonyms in code-point order, at most per_term for a word and most in all."""
    seen = list(dict.fromkeys(w.lower() for w in query))
    added: list[str] = []
    for w in list(seen):
        group = sorted({t for g in SYNONYMS if w in g for t in g if t != w} - set(seen) - set(added))
        added += group[:per_term]
    return seen + added[:most]


def expansions(queries: DataFrame, key: str, text: str, synonyms: Sequence[Sequence[str]] = SYNONYMS, per_term: int = 3) -> DataFrame:
    """For each word of each query at most per_term synonyms (n from 1, in code-point order) that the query does not hold.
    synonyms: groups of words that stand for each other; any table takes the default's place."""
    known = queries.sparkSession.createDataFrame([(t, s) for g in synonyms for t in g for s in g if s != t], "term string, synonym string")
    held = queries.select(key, F.array_distinct(words(F.col(text))).alias("_held"))
    found = held.withColumn("term", F.explode("_held")).join(F.broadcast(known), "term").where(~F.array_contains("_held", F.col("synonym")))  # a list in the code
    place = F.row_number().over(Window.partitionBy(key, "term").orderBy("synonym"))
    return found.withColumn("n", place).where(F.col("n") <= per_term).select(key, "term", "synonym", "n")


def postings(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Term counts of each row and the row's length in words."""
    exploded = rows.select(F.col(key).alias("id"), F.explode(words(F.col(text))).alias("term"))
    return exploded.groupBy("id", "term").agg(F.count("*").alias("tf"))


def bm25(spark: SparkSession, rows: DataFrame, key: str, text: str, prefixes: Sequence[str]) -> DataFrame:
    """Rows that hold a word with one of the prefixes, with their BM25 score. A prefix's frequency is the number of rows it hits."""
    sized = rows.select(F.col(key).alias("id"), words(F.col(text)).alias("w")).withColumn("len", F.size("w"))
    corpus = sized.agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    asked = spark.createDataFrame([(p,) for p in prefixes], "prefix string")
    hits = (
        sized.select("id", "len", F.explode("w").alias("word"))
        .join(F.broadcast(asked), F.startswith("word", F.col("prefix")))
        .groupBy("id", "prefix").agg(F.count("*").alias("tf"), F.first("len").alias("len"))
    )
    return bm25_of(hits.join(F.broadcast(corpus)), F.col("n"), F.col("mean"))  # one row


def bm25_of(hits: DataFrame, n: Column, mean: Column) -> DataFrame:
    """Scores from hits (id, prefix, tf, len), the number of rows and their mean length."""
    df = hits.groupBy("prefix").agg(F.count("*").alias("df"))
    scored = hits.join(F.broadcast(df), "prefix")  # a row for each prefix
    idf = F.greatest(F.lit(LEAST_IDF), F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / mean))
    return scored.groupBy("id").agg(F.sum(part).alias("score"))


def hybrid(text_hits: DataFrame, vector_hits: DataFrame, text_weight: float = 0.2, vector_weight: float = 0.8) -> DataFrame:
    """Merge ranked hits (id, place) of either kind: a place i of n counts 1 - i / (n + 1), a missing one 0."""
    n = lambda hits: hits.agg(F.count("*").alias("_n"))
    score = lambda hits, name: hits.join(F.broadcast(n(hits))).select("id", (1 - (F.col("place") - 1) / (F.col("_n") + 1)).alias(name))
    both = score(text_hits, "text_score").join(score(vector_hits, "vector_score"), "id", "full_outer")
    t, v = F.coalesce("text_score", F.lit(0.0)), F.coalesce("vector_score", F.lit(0.0))
    return both.select("id", t.alias("text_score"), v.alias("vector_score"), (text_weight * t + vector_weight * v).alias("score"))


def mmr(candidates: DataFrame, group: str, k: int, trade: float = 0.5, near: float = 0.85) -> DataFrame:
    """Greedy diverse choice of k from each query's candidates (id, score, vector): the score against the likeness to what is
    chosen, with a further penalty above `near`. A query's candidates are bounded by how many it fetched."""
    import numpy as np
    import pandas as pd

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        v = np.array(pdf["vector"].tolist(), float)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        like, gain = v @ v.T, pdf["score"].to_numpy() / max(pdf["score"].max(), 1e-12)
        chosen: list[int] = []
        while len(chosen) < min(k, len(pdf)):
            most = like[:, chosen].max(1) if chosen else np.zeros(len(pdf))
            value = trade * gain - (1 - trade) * most - np.maximum(0, most - near) if chosen else gain.copy()
            value[chosen] = -np.inf
            chosen.append(int(value.argmax()))
        return pd.DataFrame({group: pdf[group].iloc[chosen].to_numpy(), "id": pdf["id"].iloc[chosen].to_numpy(), "place": np.arange(1, len(chosen) + 1)})

    kind = dict(candidates.dtypes)
    return candidates.groupBy(group).applyInPandas(choose, f"{group} {kind[group]}, id {kind['id']}, place long")
