"""Strengths, freshness, importance and quality as column expressions; the reference time is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memloom.functions import fixed
from memloom.functions.text import contains_any


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def hours_between(earlier: Column, later: Column) -> Column:
    """Not below 0; null where a time is null."""
    hours = F.timestamp_diff("SECOND", earlier, later) / F.lit(3600.0)
    return F.when(hours < 0, 0.0).otherwise(hours)


def half_life(importance: Column, access: Column, emotion: Column, reinforced: Column, base_hours: float = 168.0) -> Column:
    return F.lit(base_hours) * (1 + importance * 2) * (1 + 0.5 * F.log1p(access)) * (1 + 1.5 * emotion) * (1 + 0.2 * reinforced)


def adaptive_strength(age_hours: Column, importance: Column, access: Column, emotion: Column, reinforced: Column, base_hours: float = 168.0, floor: float = 0.02) -> Column:
    half = half_life(importance, access, emotion, reinforced, base_hours)
    return clamp(importance * F.pow(F.lit(0.5), age_hours / half) + floor)


def hours_until(threshold: float, age_hours: Column, importance: Column, access: Column, emotion: Column, reinforced: Column, base_hours: float = 168.0, floor: float = 0.02) -> Column:
    """Hours until the strength falls to the threshold: 0 if it is below already, null if the floor never lets it."""
    if floor >= threshold:
        return F.lit(None).cast("double")
    half = half_life(importance, access, emotion, reinforced, base_hours)
    left = half * F.log2(importance / F.lit(threshold - floor)) - age_hours
    return F.when(importance <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), left))


def base_strength(age_hours: Column, importance: Column, access: Column) -> Column:
    return clamp(importance * F.pow(F.lit(0.5), age_hours * 0.1 / 24) + 0.1 * F.log1p(access))


def fact_decay(days: Column, confirmations: Column) -> Column:
    """1 where no date is known."""
    return F.when(days.isNull(), 1.0).otherwise(F.greatest(F.lit(0.1), F.exp(F.lit(-0.01) / (1 + 0.5 * F.log1p(confirmations)) * days)))


def episode_decay(days: Column, valence: Column, access: Column, rate: Column | float = 0.099) -> Column:
    rate = F.lit(rate) if isinstance(rate, float) else F.coalesce(rate, F.lit(0.099))
    return F.when(days.isNull(), 1.0).otherwise(F.greatest(F.lit(0.02), F.exp(-rate / (1 + 1.5 * F.abs(valence)) / (1 + 0.5 * F.log1p(access)) * days)))


def fact_freshness(age_hours: Column, importance: Column, confirmations: Column) -> Column:
    adaptive = adaptive_strength(age_hours, importance, confirmations, F.lit(0.3), confirmations - 1, 672.0, 0.1)
    return adaptive * clamp(F.exp(-0.01 * (age_hours / 24) / (1 + 0.5 * (confirmations - 1))), 0.1, 1.0)


def importance_score(base: Column, access: Column, days: Column, emotion: Column, confirmation: Column) -> Column:
    """Five weighted parts: base, access, recency, emotion, confirmation."""
    return clamp(0.3 * base + 0.25 * F.least(F.lit(1.0), F.log2(access + 1) / 5) + 0.2 * F.pow(F.lit(0.5), days / 14) + 0.15 * emotion + 0.1 * confirmation)


def fact_text_quality(text: Column) -> Column:
    low = F.lower(text)
    tail = F.split(F.regexp_replace(text, r"^\s*\S+", ""), r"\s+")
    proper = F.exists(tail, lambda w: F.rlike(w, F.lit(r"^\p{Lu}\p{L}*$")))
    size = F.length(text)
    part = lambda cond, value: F.when(cond, value).otherwise(0.0)
    return clamp(
        F.lit(0.5) + part(contains_any(low, fixed.HIGH_VALUE), 0.25) - part(contains_any(low, fixed.TRANSIENT), 0.3) - part(contains_any(text, fixed.CODE_LIKE), 0.2)
        - part(F.endswith(F.rtrim(text), F.lit("?")), 0.3) + part(proper, 0.1) - part(contains_any(low, fixed.GENERIC), 0.2)
        + F.when(size.between(30, 150), 0.05).when(size > 300, -0.1).otherwise(0.0)
    )


def gate(confidence: Column) -> Column:
    return F.when(confidence >= 0.7, "high").when(confidence >= 0.4, "medium").otherwise("low")


def context_confidence(base: Column, context: Column, fantasy: Column, contradicted: Column, confirmations: Column, meta: Column) -> Column:
    out = base * F.when((context == "fiction") & meta, 1.1).when(context == "fiction", 0.3).when(context == "uncertain", 0.9).otherwise(1.0)
    out = out * F.when(fantasy & ~meta, 0.6).otherwise(1.0) * F.when(contradicted, 0.7).otherwise(1.0)
    return clamp(out + 0.05 * F.greatest(F.lit(0), confirmations))


def keeper_quality(content: Column, confidence: Column, confirmations: Column, importance: Column, tags: Column, superseded: Column) -> Column:
    size = F.length(content)
    return (
        F.when(size.between(30, 200), 2.0).when(size > 200, 1.0).otherwise(0.5) + 3 * confidence + 2 * F.log1p(confirmations) + F.least(F.lit(1.0), 0.2 * tags) + 1.5 * importance
        - F.when(superseded, 5.0).otherwise(0.0)
    )


def level(score: Column) -> Column:
    return F.when(score >= 0.8, "excellent").when(score >= 0.6, "good").when(score >= 0.4, "fair").when(score >= 0.2, "poor").otherwise("critical")


def consolidation_importance(messages: Column, has_facts: Column, has_emotions: Column, intensity: Column) -> Column:
    return F.least(F.lit(1.0), 0.3 + F.least(F.lit(0.2), 0.05 * F.log1p(messages)) + F.when(has_facts, 0.2).otherwise(0.0) + F.when(has_emotions, 0.1).otherwise(0.0) + 0.2 * intensity)
