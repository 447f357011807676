"""Rule-based sentiment and topics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.functions.fixed import EMOTIONS, NEGATIONS, TOPICS
from memloom.functions.text import strings, words


def matches(text_words: Column, keywords: list[str]) -> Column:
    return F.size(F.array_intersect(text_words, strings(keywords)))


def argmax(df: DataFrame, counts: list[str], none: str, name: str, best: str) -> DataFrame:
    """Adds the name of the greatest count column (the earliest of equals; `none` if all are 0) and that count."""
    df = df.withColumn(best, F.greatest(*counts).cast("long"))
    out = F.lit(none)
    for c in reversed(counts):
        out = F.when((F.col(c) == F.col(best)) & (F.col(best) > 0), c.removeprefix("_n_")).otherwise(out)
    return df.withColumn(name, out)


def with_sentiment(df: DataFrame, text: str) -> DataFrame:
    """Adds emotion, matches and sentiment (-1..1): a fifth for each matched keyword, partly flipped by a negation.

    Steps of one column each keep the generated code small. A null text is neutral.
    """
    counts = {f"_n_{name}": matches(F.col("_w"), keys) for name, (_, keys) in EMOTIONS.items()}
    negated = F.arrays_overlap("_w", strings(x for x in NEGATIONS if x.isalpha()))
    df = df.withColumn("_w", F.array_distinct(words(F.col(text)))).withColumns({**counts, "_negated": negated})
    df = argmax(df, list(counts), "neutral", "emotion", "matches")
    sign = F.lit(0)
    for name, (valence, _) in EMOTIONS.items():
        sign = F.when(F.col("emotion") == name, valence).otherwise(sign)
    score = sign * F.least(F.col("matches") / 5.0, F.lit(1.0)) * F.when(F.col("_negated"), -0.7).otherwise(1.0)
    return df.withColumn("sentiment", score).drop("_w", "_negated", *counts)


def with_topic(df: DataFrame, text: str) -> DataFrame:
    """Adds category: that of the topics with the most keywords in the text, the earliest of equals; general without any."""
    counts = {f"_n_{name}": matches(F.col("_w"), keys) for name, keys in TOPICS.items()}
    df = df.withColumn("_w", F.array_distinct(words(F.col(text)))).withColumns(counts)
    return argmax(df, list(counts), "general", "category", "_most").drop("_w", "_most", *counts)
