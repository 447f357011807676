"""Tokenizers and set likenesses as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from memloom.functions.fixed import STOP_WORDS

#: Letters of any script, digits and underscores: what a word is made of.
WORD = r"([\p{L}\p{N}_]+)"


def strings(values: Iterable[str]) -> Column:
    return F.array(*map(F.lit, values))


def words(text: Column) -> Column:
    """Lower-cased words in order, repeats kept; a null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(1))


def terms(text: Column) -> Column:
    """Words of two letters or more that are no stop words, in order, repeats kept."""
    stop = strings(STOP_WORDS)
    return F.filter(words(text), lambda w: (F.length(w) >= 2) & ~F.array_contains(stop, w))


def jaccard(a: Column, b: Column) -> Column:
    """Likeness of two arrays as sets; 0 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def contains_any(text: Column, needles: Iterable[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(text, F.lit(n))
    return out


def tokens_by_length(text: Column) -> Column:
    """The estimate of a quarter of the code points."""
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")).cast("long")


def week_key(ts: Column) -> Column:
    """Year and Monday-based week of the year, days before the first Monday in week 0."""
    week = F.floor((F.dayofyear(ts) + 6 - F.weekday(ts)) / 7)
    return F.concat(F.year(ts), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))
