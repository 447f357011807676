"""Time phrases of a query: a range of times for the first phrase that is understood. The reference time is a parameter."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
Range = tuple[datetime, datetime]


def _day(t: datetime) -> Range:
    start = t.replace(hour=0, minute=0, second=0, microsecond=0)
    return start, start + timedelta(days=1)


def _month(year: int, month: int) -> Range:
    return datetime(year, month, 1), datetime(year + month // 12, month % 12 + 1, 1)


def parse(query: str, as_of: datetime) -> Range | None:
    """The half-open range that the query's first known phrase means, in the order of this table; None without any."""
    text = query.lower()
    monday = _day(as_of)[0] - timedelta(days=as_of.weekday())
    if "yesterday" in text:
        return _day(as_of - timedelta(days=1))
    if "today" in text:
        return _day(as_of)
    if m := re.search(r"(\d+)\s+hours?\s+ago", text):
        at = as_of - timedelta(hours=int(m[1]))
        return at - timedelta(minutes=30), at + timedelta(minutes=30)
    if m := re.search(r"(\d+)\s+days?\s+ago", text):
        at = as_of - timedelta(days=int(m[1]))
        return at - timedelta(hours=12), at + timedelta(hours=12)
    if m := re.search(r"(\d+)\s+weeks?\s+ago", text):
        start = monday - timedelta(weeks=int(m[1]))
        return start, start + timedelta(weeks=1)
    if m := re.search(r"(?:last|past)\s+(\d+)\s+days?", text):
        return as_of - timedelta(days=int(m[1])), as_of
    if "last week" in text:
        return monday - timedelta(weeks=1), monday
    if "this week" in text:
        return monday, monday + timedelta(weeks=1)
    if "last month" in text:
        return _month(as_of.year - (as_of.month == 1), (as_of.month - 2) % 12 + 1)
    if "this month" in text:
        return _month(as_of.year, as_of.month)
    if "last year" in text:
        return datetime(as_of.year - 1, 1, 1), datetime(as_of.year, 1, 1)
    if m := re.search(rf"\b({'|'.join(MONTHS)})\b(?:\s+(\d{{4}}))?", text):
        month = MONTHS.index(m[1]) + 1
        return _month(int(m[2]) if m[2] else as_of.year - (month > as_of.month), month)
    if m := re.search(r"\b((?:19|20)\d{2})\b", text):
        return datetime(int(m[1]), 1, 1), datetime(int(m[1]) + 1, 1, 1)
    return None


def time_range(query: Column, as_of: Column) -> tuple[Column, Column]:
    """As parse, for a table of queries each with its own reference time (timestamp_ntz): begin and end, null without a phrase.
    A number too large for a date gives null."""
    text, day = F.lower(F.coalesce(query, F.lit(""))), F.to_date(as_of)
    stamp = lambda date: date.cast("timestamp_ntz")
    add = lambda unit, n, t: F.timestamp_add(unit, n, t)
    monday, month = F.date_sub(day, F.weekday(day)), F.trunc(day, "month")
    holds = lambda phrase: F.contains(text, F.lit(phrase))
    found = lambda pattern, group=1: F.regexp_extract(text, pattern, group)
    number = lambda pattern: F.when(F.length(found(pattern)) < 7, found(pattern).try_cast("int"))
    days = lambda date, n: (stamp(date), add("DAY", F.lit(n), stamp(date)))
    hours, ago, weeks, past = r"(\d+)\s+hours?\s+ago", r"(\d+)\s+days?\s+ago", r"(\d+)\s+weeks?\s+ago", r"(?:last|past)\s+(\d+)\s+days?"
    named = rf"\b({'|'.join(MONTHS)})\b(?:\s+(\d{{4}}))?"
    of = F.array_position(F.array(*map(F.lit, MONTHS)), found(named)).cast("int")
    said_year = found(named, 2).try_cast("int")
    first = F.make_date(F.coalesce(said_year, F.year(day) - F.when(of > F.month(day), 1).otherwise(0)), F.greatest(of, F.lit(1)), F.lit(1))
    year = found(r"\b((?:19|20)\d{2})\b").try_cast("int")
    at_hour, at_day = add("HOUR", -number(hours), as_of), add("DAY", -number(ago), as_of)
    january = lambda y: stamp(F.make_date(y, F.lit(1), F.lit(1)))
    week = stamp(F.date_sub(monday, 7 * number(weeks)))
    rules = (
        (holds("yesterday"), *days(F.date_sub(day, 1), 1)),
        (holds("today"), *days(day, 1)),
        (found(hours) != "", add("MINUTE", F.lit(-30), at_hour), add("MINUTE", F.lit(30), at_hour)),
        (found(ago) != "", add("HOUR", F.lit(-12), at_day), add("HOUR", F.lit(12), at_day)),
        (found(weeks) != "", week, add("DAY", F.lit(7), week)),
        (found(past) != "", add("DAY", -number(past), as_of), as_of),
        (holds("last week"), *days(F.date_sub(monday, 7), 7)),
        (holds("this week"), *days(monday, 7)),
        (holds("last month"), stamp(F.add_months(month, -1)), stamp(month)),
        (holds("this month"), stamp(month), stamp(F.add_months(month, 1))),
        (holds("last year"), january(F.year(day) - 1), january(F.year(day))),
        (found(named) != "", stamp(first), stamp(F.add_months(first, 1))),
        (year.isNotNull(), january(year), january(year + 1)),
    )
    begin = end = F.lit(None).cast("timestamp_ntz")
    for condition, a, b in reversed(rules):
        begin, end = F.when(condition, a).otherwise(begin), F.when(condition, b).otherwise(end)
    return begin, end


def in_time_range(at: Column, query: Column, as_of: Column) -> Column:
    """Whether a time lies in the range that a query means; false for a query without a phrase."""
    begin, end = time_range(query, as_of)
    return F.coalesce((at >= begin) & (at < end), F.lit(False))
