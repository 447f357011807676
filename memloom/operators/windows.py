"""Window-shaped operators: ranks, budgets, sessions, neighbours in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def prefix_budget(rows: DataFrame, group: list[str], order: list[Column], cost: Column, budget: int) -> DataFrame:
    """Within each group the leading rows whose costs together stay within the budget; the first overflow ends it."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(cost).over(w)).where(F.col("used") <= budget)


def first_by(rows: DataFrame, key: list[Column], order: list[Column]) -> DataFrame:
    """Of equal keys the row that comes first."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def top_per(rows: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("place") <= k)


def sessions(rows: DataFrame, key: list[str], ts: str, order: list[Column], gap_seconds: int) -> DataFrame:
    """Adds session: a running number within the key; a longer gap than this begins a new one."""
    w = Window.partitionBy(*key).orderBy(*order)
    new = F.coalesce(F.timestamp_diff("SECOND", F.lag(ts).over(w), F.col(ts)) > gap_seconds, F.lit(True))
    return rows.withColumn("_new", new.cast("long")).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def anniversaries(rows: DataFrame, ts: str, as_of: Column, tolerance_days: int = 3) -> DataFrame:
    """Rows of earlier years whose day, moved to the year of as_of, lies within the tolerance; 29 February is skipped where that year has none."""
    moved = F.make_date(F.year(as_of), F.month(ts), F.when((F.month(ts) == 2) & (F.dayofmonth(ts) == 29), F.lit(28)).otherwise(F.dayofmonth(ts)))
    leap = (F.month(ts) == 2) & (F.dayofmonth(ts) == 29) & (F.dayofmonth(F.last_day(F.make_date(F.year(as_of), F.lit(2), F.lit(1)))) == 28)
    near = F.abs(F.datediff(moved, F.to_date(as_of))) <= tolerance_days
    return rows.where((F.year(ts) < F.year(as_of)) & ~leap & near).withColumn("years", F.year(as_of) - F.year(ts))


def predecessors(rows: DataFrame, key: str, group: str, ts: str, hours: int) -> DataFrame:
    """For each row the latest earlier row of its group within so many hours, by a window instead of a range join."""
    w = Window.partitionBy(group).orderBy(ts, key)
    out = rows.withColumn("previous", F.lag(key).over(w)).withColumn("_gap", F.timestamp_diff("SECOND", F.lag(ts).over(w), F.col(ts)))
    return out.where((F.col("_gap") > 0) & (F.col("_gap") <= hours * 3600)).withColumn("gap_hours", F.col("_gap") / 3600.0).drop("_gap")
