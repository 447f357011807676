"""Stores as DataFrames: lookups, pages, upserts, deletes and the state changes of single rows. Nothing is written on a read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == F.lit(value)).limit(1)


def page(df: DataFrame, order: list[Column], limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of a table in a full order: end the order with a key."""
    return df.orderBy(*order).offset(offset).limit(limit)


def upsert(store: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows replace those with their key; others stay. Columns that one side lacks become null."""
    return store.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def latest(versions: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Of each key the last version."""
    w = Window.partitionBy(key).orderBy(*order)
    return versions.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def delete(store: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return store.join(keys.select(key), key, "left_anti")


def soft_delete(store: DataFrame, keys: DataFrame, key: str, changes: dict[str, Column]) -> DataFrame:
    """Set columns of the rows that keys name; the rows stay."""
    marked = store.join(keys.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    return marked.withColumns({c: F.when(F.col("_hit"), v).otherwise(F.col(c)) for c, v in changes.items()}).drop("_hit")


def every(*conditions: Column | None) -> Column:
    """All of the conditions that are given."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def like_pattern(query: str) -> str:
    """A LIKE pattern for a literal substring."""
    return "%" + query.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"


def reinforced(store: DataFrame, log: DataFrame, key: str, boost: float = 0.02) -> DataFrame:
    """Apply an access log: counts add up, importance rises by boost for each access, up to 1."""
    hits = log.groupBy(key).agg(F.count("*").alias("_hits"), F.max("ts").alias("_last"))
    joined = store.join(hits, key, "left")
    n = F.coalesce("_hits", F.lit(0))
    return joined.withColumns({"access_count": F.col("access_count") + n, "importance": F.least(F.lit(1.0), F.col("importance") + boost * n), "last_accessed": F.col("_last")}).drop("_hits", "_last")


def validated(rows: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """Adds errors: what is wrong with each row of a bulk import."""
    checks = [
        F.when(F.length(F.trim(F.coalesce("content", F.lit("")))) == 0, F.lit("content is empty")),
        F.when(~F.col("fact_type").isin(*types) | F.col("fact_type").isNull(), F.lit("unknown type")),
        F.when(~F.col("confidence").between(0, 1) | F.col("confidence").isNull(), F.lit("confidence out of range")),
    ]
    return rows.withColumn("errors", F.array_compact(F.array(*checks)))


def archived(store: DataFrame, key: str, kind: str, reason: str) -> DataFrame:
    """Archive entries: the row as JSON beside what is searched by."""
    return store.select(F.col(key).cast("string").alias("archive_id"), F.lit(kind).alias("entry_type"), F.lit(reason).alias("reason"), F.to_json(F.struct(*store.columns)).alias("payload"))


def restored(archive: DataFrame, schema: str) -> DataFrame:
    return archive.select(F.from_json("payload", schema).alias("_row")).select("_row.*")
