"""Operators over conversations: chunks, continuations, clusters, merges, context."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memloom.functions.fixed import SYNONYMS
from memloom.functions.text import contains_any, words

# What marks a talk about fiction, a change of topic, a follow-up or a comparison.
FICTION = ("novel", "story", "character", "chapter", "fiction", "protagonist", "worldbuilding", "screenplay")
CHANGES = ("anyway", "by the way", "on another note", "changing topic", "speaking of", "let's talk about")
FOLLOW_UPS = ("tell me more", "go on", "what else", "continue", "and then")
COMPARISONS = ("compare", "versus", " vs ", "difference between", "similar to")


def chunks(messages: DataFrame, key: str, order: str, text: str, least: int = 4, most: int = 50, window: int = 5, threshold: float = 0.3) -> DataFrame:
    """Adds chunk: a running number within each conversation. A chunk ends where the words of the next messages are unlike
    those of the ones before, or a phrase changes the topic, or it is full; it has `least` messages at least.

    The signals are window expressions; only the walk along one conversation's flags, which resets at each boundary, is a fold.
    """
    w = Window.partitionBy(key).orderBy(order)
    near = messages.withColumn("_w", words(F.col(text)))
    before = F.array_distinct(F.flatten(F.collect_list("_w").over(w.rowsBetween(-window, -1))))
    after = F.array_distinct(F.flatten(F.collect_list("_w").over(w.rowsBetween(0, window - 1))))
    near = near.withColumn("_a", before).withColumn("_b", after)
    size = F.size(F.array_union("_a", "_b"))
    unlike = F.when(size > 0, F.size(F.array_intersect("_a", "_b")) / size < threshold).otherwise(False)
    flags = near.withColumn("_shift", contains_any(F.lower(F.col(text)), CHANGES) | unlike).select(*messages.columns, "_shift")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in messages.schema.fields)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        number, start, out = 0, 0, []
        for i, shift in enumerate(pdf["_shift"].tolist()):
            if i - start >= least and (shift or i - start >= most):
                number, start = number + 1, i
            out.append(number)
        return pdf.assign(chunk=np.array(out, np.int64)).drop(columns="_shift")

    return flags.groupBy(key).applyInPandas(walk, f"{fields}, chunk long")


def continuation(similarity: Column, same_topic: Column, hours: Column, explicit: Column) -> Column:
    """How likely a conversation continues another: likeness from 0.3 on, topic, recency within 72 hours, an explicit reference."""
    recency = F.greatest(F.lit(0.0), 1 - hours / 72.0)
    return F.least(F.lit(1.0), F.when(similarity >= 0.3, similarity * 0.5).otherwise(0.0) + F.when(same_topic, 0.3).otherwise(0.0) + recency * 0.2 + F.when(explicit, 0.3).otherwise(0.0))


def _clustered(sizes: np.ndarray, words: np.ndarray, row: np.ndarray, likeness: float) -> np.ndarray:
    """The clusters of rows in their order, of so many words each; words (numbers from 0) with their rows in order. A seed's open
    rows are not walked one by one: the words that it unites lead to the rows that hold them, whose overlaps are counted, and
    the next row that is alike enough is looked up. It then adds its words, so overlaps only grow, and only rows behind it can
    still join. Rows that are in a cluster are dropped from the words' lists whenever they are half of them."""
    n = len(sizes)
    first = np.concatenate([[0], np.cumsum(sizes)])
    place, number, left, listed = np.full(n, -1, np.int64), 0, n, 2 * n + 1
    for seed in range(n):
        if place[seed] >= 0:
            continue
        if 2 * left < listed:
            listed, open_ = left, np.flatnonzero(place[row] < 0)
            order = open_[np.argsort(words[open_], kind="stable")]
            holders, at = row[order], np.searchsorted(words[order], np.arange(words.max(initial=-1) + 2))
        place[seed], united, here = number, set(), seed
        new, shared = words[first[seed] : first[seed + 1]].tolist(), np.zeros(n, np.int64)
        while True:
            left -= 1
            united.update(new)
            if new:
                shared += np.bincount(np.concatenate([holders[at[w] : at[w + 1]] for w in new]), minlength=n)
            fits = here + 1 + np.flatnonzero(shared[here + 1 :] >= max(1, likeness * len(united) * (1 - 1e-9)))
            fits = fits[place[fits] < 0]
            fits = fits[shared[fits] / (len(united) + sizes[fits] - shared[fits]) >= likeness]
            if not len(fits):
                break
            here = int(fits[0])
            place[here] = number
            new = [w for w in words[first[here] : first[here + 1]].tolist() if w not in united]
        number += 1
    return place


def clusters(rows: DataFrame, group: str, key: str, keywords: str, likeness: float = 0.2) -> DataFrame:
    """Greedy clusters within each group: from the row with the most keywords on, each open row joins the first cluster whose
    united keywords are alike enough. Order-dependent by definition, so a group is one fold; the groups are parallel. Keywords
    are distinct and compared by 64-bit hashes; likeness is above 0."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = pdf["_keys"].to_numpy()
        size = np.array([len(s) for s in sets], np.int64)
        order = sorted(range(len(pdf)), key=lambda i, ids=pdf[key].tolist(): (-size[i], ids[i]))
        ids, size = [pdf[key].iloc[i] for i in order], size[order]
        _, words = np.unique(np.concatenate([np.zeros(0, np.int64), *(sets[i] for i in order)]).astype(np.int64), return_inverse=True)
        return pd.DataFrame({group: pdf[group].iloc[0], key: ids, "cluster": _clustered(size, words, np.repeat(np.arange(len(ids)), size), likeness)})

    kinds = dict(rows.dtypes)
    hashes = F.transform(F.array_distinct(keywords), lambda w: F.xxhash64(w))
    return rows.select(group, key, hashes.alias("_keys")).groupBy(group).applyInPandas(fold, f"{group} {kinds[group]}, {key} {kinds[key]}, cluster long")


def context(messages: DataFrame, key: str, text: str) -> DataFrame:
    """fiction or reality for each conversation, by how many markers its messages hold."""
    found = F.aggregate(F.array(*(F.when(F.contains(F.lower(F.col(text)), F.lit(m)), 1).otherwise(0) for m in FICTION)), F.lit(0), lambda s, x: s + x)
    n = messages.groupBy(key).agg(F.sum(found).alias("markers"))
    return n.select(key, "markers", F.when(F.col("markers") > 0, "fiction").otherwise("reality").alias("context"), F.when(F.col("markers") >= 3, 0.9).when(F.col("markers") >= 1, 0.7).otherwise(0.8).alias("confidence"))


def query_class(text: Column) -> Column:
    """What kind of search a query asks for: the strongest of follow-up, comparison and theme; general below 0.25."""
    low = F.lower(text)
    count = lambda needles: F.aggregate(F.array(*(F.when(F.contains(low, F.lit(n)), 1).otherwise(0) for n in needles)), F.lit(0), lambda s, x: s + x)
    themes = F.array(*map(F.lit, sorted({t for g in SYNONYMS for t in g})))
    follow, compare, theme = F.least(F.lit(1.0), count(FOLLOW_UPS) * 0.4), F.least(F.lit(1.0), count(COMPARISONS) * 0.4), F.least(F.lit(1.0), F.size(F.array_intersect(words(text), themes)) * 0.3)
    best = F.greatest(follow, compare, theme)
    return F.when(best < 0.25, "general").when(follow == best, "follow_up").when(compare == best, "comparison").otherwise("thematic")


#: Best pairs that the driver looks at in one round.
ROUND = 1_000


def greedy_matches(pairs: DataFrame, most: int = 10) -> DataFrame:
    """The best merges of pairs (a, b, score): by score (then the lesser ids), each row once, at most so many.

    Only pairs above the last pick matter. Each round takes the ROUND best pairs that touch nothing used and picks among them
    in order, one at least, so there are `most` rounds at most, and one as a rule."""
    columns, picked, used = pairs.select("a", "b", "score"), [], set()
    while len(picked) < most:
        free = columns.where(~F.col("a").isin(sorted(used)) & ~F.col("b").isin(sorted(used))) if used else columns
        block = free.orderBy(F.desc("score"), "a", "b").limit(ROUND).collect()
        for r in block:
            if len(picked) < most and r["a"] not in used and r["b"] not in used:
                picked.append(tuple(r))
                used |= {r["a"], r["b"]}
        if len(block) < ROUND:
            break
    return pairs.sparkSession.createDataFrame(picked, columns.schema)
