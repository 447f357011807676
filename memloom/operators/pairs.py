"""Pairs of like texts: closed-form TF-IDF cosine over blocks of all pairs, and a set join with prefixes that lose nothing."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memloom.functions.text import terms
from memloom.operators import blocks

#: A term of one text of two weighs this against one of both.
UNIQUE = 1 + math.log(1.5)


def term_counts(rows: DataFrame, key: str, text: str) -> DataFrame:
    return rows.select(F.col(key).alias("id"), F.explode(terms(F.col(text))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def counted(rows: DataFrame, key: str, text: str, extra: Sequence[str] = (), new: str | None = None) -> blocks.Packed:
    """The rows' terms as chunks; rows that share a key are one text, as in term_counts."""
    more = [*extra, *([new] if new else [])]
    keyed = rows.select(F.col(key).alias("id"), blocks.hashed(terms(F.col(text))).alias("_h"), *more)
    whole = keyed.groupBy("id").agg(F.flatten(F.collect_list("_h")).alias("_h"), *(F.max(c).alias(c) for c in more))
    return blocks.pack(whole, "_h", extra, new)


def term_cosine(met: blocks.Meeting, threshold: float, or_else: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a meeting whose pair cosine exceeds the threshold, or which or_else marks, with that cosine. No pair cosine is
    above the cosine of the counts, so a block without such a one needs no further product."""
    a, b = met.a, met.b
    dot = met.product("x", "x")
    c2, low = UNIQUE * UNIQUE, threshold * threshold * (1 - 1e-4)
    na, nb = (x.norms.astype(dot.dtype) for x in (a, b))
    square = dot * dot
    near = square > (low * na)[:, None] * nb
    if not near.any() and (or_else is None or not or_else.any()):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0)
    sa, sb = met.product("xx", "1"), met.product("1", "xx")
    least = (low * c2 * na)[:, None] - dot.dtype.type(low * (c2 - 1)) * sa
    least *= (c2 * nb) - dot.dtype.type(c2 - 1) * sb
    near &= square > least
    i, j = np.nonzero(near if or_else is None else near | or_else)
    d, sa, sb, na, nb = dot[i, j].astype(np.float64), sa[i, j].astype(np.float64), sb[i, j].astype(np.float64), a.norms[i], b.norms[j]
    below = np.sqrt((sa + c2 * (na - sa)) * (sb + c2 * (nb - sb)))
    cosine = np.divide(d, below, out=np.zeros(len(d)), where=d > 0)
    ok = cosine > threshold if or_else is None else (cosine > threshold) | or_else[i, j]
    return i[ok], j[ok], cosine[ok]


def similar_pairs(rows: DataFrame, key: str, text: str, threshold: float, new: str | None = None) -> DataFrame:
    """Pairs (a < b) whose pair cosine exceeds the threshold. new: a boolean column; then only pairs with such a row are sought.

    With so few words as conversations have, most texts share one and prefixes of rare terms leave most pairs; so all pairs
    meet, in blocks of matrix products over the counts (`operators/blocks.py`).
    """

    def rule(met: blocks.Meeting) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        i, j, cosine = term_cosine(met, threshold)
        return i, j, [cosine]

    return blocks.pairs(counted(rows, key, text, new=new), rule, "similarity double", marked=new is not None)


def corpus_cosine(rows: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    """Pairs (a < b) whose TF-IDF vectors over all rows as the corpus have a cosine (similarity) above the threshold."""
    n = rows.count()
    packed = blocks.with_frequencies(counted(rows, key, text))

    def weighted(row: Sequence, of: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return of, keys, counts * (np.log((n + 1) / (blocks.frequency_of(row, keys) + 1)) + 1)

    def rule(met: blocks.Meeting) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        dot, na, nb = met.product("x", "x"), met.a.norms, met.b.norms
        i, j = np.nonzero(dot > (threshold * (1 - 1e-9) * np.sqrt(na))[:, None] * np.sqrt(nb))
        cosine = dot[i, j] / np.sqrt(na[i] * nb[j])
        ok = cosine > threshold
        return i[ok], j[ok], [cosine[ok]]

    return blocks.pairs(packed, rule, "similarity double", valued=weighted)


def alike(met: blocks.Meeting, threshold: float, or_else: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Pairs of a meeting of sets whose Jaccard likeness reaches the threshold, or which or_else marks: their places, sizes, the
    words they share, and the likeness."""
    shared, na, nb = met.product("x", "x"), met.a.sizes, met.b.sizes
    kind = shared.dtype.type
    low = threshold * (1 - 1e-5)
    near = (shared * kind(1 + low) >= (low * na).astype(kind)[:, None] + (low * nb).astype(kind)) & (shared > 0)
    i, j = np.nonzero(near if or_else is None else near | or_else)
    na, nb, shared = na[i], nb[j], shared[i, j].astype(np.int64)
    like = shared / np.maximum(1, na + nb - shared)
    ok = like >= threshold if or_else is None else (like >= threshold) | or_else[i, j]
    return i[ok], j[ok], na[ok], nb[ok], shared[ok], like[ok]


def like_sets(rows: DataFrame, threshold: float) -> DataFrame:
    """Pairs a < b of rows (id, w: distinct words) whose Jaccard likeness reaches the threshold, above 0, and that likeness."""

    def rule(met: blocks.Meeting) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        i, j, *_, like = alike(met, threshold)
        return i, j, [like]

    return blocks.pairs(blocks.pack(rows.select("id", blocks.hashed(F.col("w")).alias("_h")), "_h"), rule, "likeness double")


#: Sets that hold one term and meet in one task; more of them are dealt over several by salts.
HOT = 20_000


def overlapping_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """Candidates a < b that hold every pair of rows (id, w: distinct words) whose word sets have a Jaccard likeness of at least
    the threshold.

    Equal sets are compared once, under their least id. Two like sets share a word among the rarest n - ceil(threshold * n) + 1
    of either's n words, so these prefixes alone meet; and the rarest word that they share has, with all more frequent ones,
    enough words left on either side for the overlap that both sizes ask for. Terms of many sets are dealt by salts.
    """
    keyed = sets.select("id", "w", F.sha2(F.array_join(F.array_sort("w"), " "), 256).alias("_key"))
    once = keyed.groupBy("_key").agg(F.min("id").alias("_set"), F.first("w").alias("w"), F.count("*").alias("_copies"))
    ranked = once.select("_set", F.size("w").alias("n"), F.explode("w").alias("term"))
    ranked = ranked.join(ranked.groupBy("term").agg(F.count("*").alias("df")), "term").where("df > 1")
    left = F.row_number().over(Window.partitionBy("_set").orderBy(F.desc("df"), F.desc("term")))  # this word and all more frequent ones
    prefix = ranked.withColumn("_left", left).where(F.col("_left") >= F.ceil(F.lit(threshold) * F.col("n") - 1e-9))
    salts = F.ceil(F.col("df") / HOT).cast("int")
    a = prefix.select(F.col("_set").alias("_a"), F.col("n").alias("_na"), F.col("_left").alias("_la"), "term", F.pmod(F.xxhash64("_set"), salts).cast("int").alias("_salt"))
    b = prefix.select(F.col("_set").alias("_b"), F.col("n").alias("_nb"), F.col("_left").alias("_lb"), "term", F.explode(F.sequence(F.lit(0), salts - 1)).alias("_salt"))
    needed = F.lit(threshold / (1 + threshold)) * (F.col("_na") + F.col("_nb")) - 1e-9
    met = a.join(b, ["term", "_salt"]).where((F.col("_a") < F.col("_b")) & (F.least("_la", "_lb") >= needed)).select("_a", "_b").distinct()
    copies = keyed.join(once.where("_copies > 1").select("_key", "_set"), "_key").select("_set", "id")  # sets that several rows hold
    members = once.where("_copies = 1").select("_set", F.col("_set").alias("id")).unionByName(copies)
    member = lambda key, name: members.select(F.col("_set").alias(key), F.col("id").alias(name))
    across = met.join(member("_a", "x"), "_a").join(member("_b", "y"), "_b")
    within = copies.withColumnRenamed("id", "x").join(copies.withColumnRenamed("id", "y"), "_set").where("x < y")
    return across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).unionByName(within.select(F.col("x").alias("a"), F.col("y").alias("b")))


def holders(sets: DataFrame, opposites: Sequence[tuple[str, str]]) -> DataFrame:
    """The rows that hold a word which has an opposite."""
    return sets.where(F.arrays_overlap("w", F.array(*map(F.lit, sorted({x for p in opposites for x in p})))))


def opposite_pairs(sets: DataFrame, opposites: Sequence[tuple[str, str]], same: Sequence[str] = ()) -> DataFrame:
    """Pairs a < b of rows (id, w) of which one holds a word and the other its opposite, alike in the columns `same`."""
    held = sets.select("id", *same, F.explode("w").alias("term")).where(F.col("term").isin(sorted({x for p in opposites for x in p})))
    others = {x: sorted({q for p, q in opposites if p == x} | {p for p, q in opposites if q == x}) for x in {x for p in opposites for x in p}}
    other = F.create_map(*(v for x in sorted(others) for v in (F.lit(x), F.array(*map(F.lit, others[x])))))
    asked = held.select(F.col("id").alias("a"), *same, F.explode(other[F.col("term")]).alias("term"))
    return asked.join(held.withColumnRenamed("id", "b"), ["term", *same]).where("a < b").select("a", "b").distinct()
