"""Relationship and contradiction rules over pairs of texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memloom.functions.fixed import CONTRARIES, NEGATIONS, NO_VALUES, OPPOSITES, PAST, PRESENT, SEVERAL, SINGULAR, TIME_WORDS
from memloom.functions.text import contains_any, strings


def overlap(a: Column, b: Column) -> Column:
    """Jaccard likeness of two word sets."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def negated(words: Column) -> Column:
    return F.arrays_overlap(words, strings(NEGATIONS))


def opposite(a: Column, b: Column) -> Column:
    """Whether one text has a word and the other its opposite."""
    pairs = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in OPPOSITES))
    has = F.array_contains
    return F.exists(pairs, lambda p: (has(a, p["x"]) & has(b, p["y"])) | (has(a, p["y"]) & has(b, p["x"])))


def contradiction(a: Column, b: Column, same_topic: Column, same_type: Column, superseded: Column) -> Column:
    """Confidence that two facts contradict each other, null below the gate or below 0.3."""
    like = overlap(a, b)
    score = (
        F.when((like >= 0.25) & (negated(a) != negated(b)), 0.35).otherwise(0.0) + F.when(opposite(a, b), 0.35).otherwise(0.0)
        + F.when(same_type & same_topic, 0.15).otherwise(0.0) + F.when(superseded & (like >= 0.2), 0.2).otherwise(0.0)
    )
    return F.when(((like >= 0.15) | same_topic) & (score >= 0.3), F.least(F.lit(1.0), score))


def elaboration(a: Column, b: Column, same_topic: Column, same_type: Column) -> Column:
    """Confidence that one fact elaborates the other, null below the gate or below 0.3."""
    like, na, nb = overlap(a, b), F.size(a), F.size(b)
    small, large = F.least(na, nb), F.greatest(na, nb)
    inside = F.when(small > 0, F.size(F.array_intersect(a, b)) / small).otherwise(0.0)
    ratio = F.when(small > 0, large / small).otherwise(0.0)
    score = (
        F.when((inside >= 0.6) & (ratio >= 1.3), 0.4).otherwise(0.0) + F.when(same_topic, 0.2).otherwise(0.0) + F.when(same_type, 0.1).otherwise(0.0)
        + F.when((large - small) / F.greatest(large, F.lit(1)) > 0.3, 0.15).otherwise(0.0)
    )
    return F.when((like >= 0.2) & (score >= 0.3), F.least(F.lit(1.0), score))


def contrary(new: Column, known: Column) -> Column:
    """0.8 where one text (in lower case) holds a word and the other its contrary, 0.9 for "not" before the word, else null."""
    out = F.lit(None).cast("double")
    for yes, no in reversed(CONTRARIES):
        has = lambda t, w: F.contains(t, F.lit(w))
        plain = (has(new, yes) & has(known, no)) | (has(new, no) & has(known, yes))
        denied = (has(new, yes) & has(known, f"not {yes}")) | (has(new, f"not {yes}") & has(known, yes))
        out = F.when(plain, 0.8).when(denied, 0.9).otherwise(out)
    return out


def attribute(text: Column) -> tuple[Column, Column]:
    """Key and value of "key: value" in lower case; the key is null where there is no colon."""
    low = F.lower(text)
    return F.when(F.contains(low, F.lit(":")), F.trim(F.substring_index(low, ":", 1))), F.trim(F.regexp_replace(low, "^[^:]*:", ""))


def value_change(new: Column, known: Column) -> Column:
    """0.85 where two facts give different values to one attribute that has one value; 0.7 where alike texts name different
    first numbers; else null. Values that begin like a sentence, and short ones, count as none."""
    (key, value), (key2, value2) = attribute(new), attribute(known)
    keyed = key.isNotNull() & key2.isNotNull()
    vague = key.isin(*SEVERAL) | (F.length(value) < 3) | (F.length(value2) < 3)
    for word in NO_VALUES:
        vague = vague | F.startswith(value, F.lit(word)) | F.startswith(value2, F.lit(word))
    first = lambda t: F.regexp_extract(t, r"\d+", 0)
    bare = lambda t: F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(t), r"\d+", ""), r"\s+"), lambda w: w != ""))
    number = (first(new) != "") & (first(known) != "") & (first(new) != first(known)) & (overlap(bare(new), bare(known)) > 0.7)
    return F.when(keyed & vague, None).when(keyed & (key == key2) & (value != value2), 0.85).when(number, 0.7)


def singular_conflict(new: Column, known: Column) -> Column:
    """0.75 where two facts name different values of an attribute that has only one; else null."""
    (key, value), (key2, value2) = attribute(new), attribute(known)
    vague = (F.length(value) <= 2) | (F.length(value2) <= 2)
    for word in ("not", "still", "doing", "being", "just", "the"):
        vague = vague | F.startswith(value, F.lit(word)) | F.startswith(value2, F.lit(word))
    long_name = (key == "name") & ((F.size(F.split(value, r"\s+")) > 2) | (F.size(F.split(value2, r"\s+")) > 2))
    return F.when((key == key2) & key.isin(*SINGULAR) & ~vague & ~long_name & (value != value2), 0.75)


def sequence(a: Column, b: Column, words_a: Column, words_b: Column, same_topic: Column, learned_a: Column, learned_b: Column) -> tuple[Column, Column]:
    """Confidence that two facts follow one another (null below the gate or 0.3), and whether a comes first."""
    past_a, past_b, now_a, now_b = (F.rlike(t, F.lit(f"(?i){p}")) for p in (PAST, PRESENT) for t in (a, b))
    year = lambda t: F.array_min(F.transform(F.regexp_extract_all(t, F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1)), lambda y: y.cast("int")))
    gap = F.unix_timestamp(learned_b.cast("timestamp")) - F.unix_timestamp(learned_a.cast("timestamp"))
    forward, backward = past_a & now_b & ~past_b, past_b & now_a & ~past_a
    years = F.coalesce(year(a) != year(b), F.lit(False))
    score = (
        F.when(forward | backward, 0.35).otherwise(0.0) + F.when(years, 0.4).otherwise(0.0) + F.when(F.abs(gap) > 3600, 0.15).otherwise(0.0)
        + F.when(contains_any(F.lower(a), TIME_WORDS) | contains_any(F.lower(b), TIME_WORDS), 0.1).otherwise(0.0) + F.when(same_topic, 0.15).otherwise(0.0)
    )
    way = (
        F.when(forward, 1.0).when(backward, -1.0).otherwise(0.0) + F.when(years, F.when(year(a) < year(b), 1.0).otherwise(-1.0)).otherwise(0.0)
        + F.when(gap > 3600, 0.5).when(gap < -3600, -0.5).otherwise(0.0)
    )
    close = (overlap(words_a, words_b) >= 0.1) | same_topic
    return F.when(close & (F.round(score, 6) >= 0.3), F.least(F.lit(1.0), score)), way >= 0
