"""The flagship plan: from a query string to the facts that fit the budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions import scoring as sc
from memloom.functions.text import word_count
from memloom.operators import search, windows
from memloom.operators.postings import TextIndex
from memloom.plans.views import as_of


def budgeted_recall(spark: SparkSession, facts: DataFrame, query: str, topic: str | None, budget: int = 200, candidates: int = 50, index: TextIndex | None = None) -> DataFrame:
    """Expand the query, find candidates by BM25 (from a stored index of the facts, where there is one), weigh them by freshness, confirmations and topic, drop repeated contents,
    and keep the leading ones whose words fit the budget. The candidates, a top-k, bound what one task ranks."""
    asked = search.expanded(query.split())
    hits = index.bm25(asked) if index else search.bm25(spark, facts, "id", "content", asked)
    hits = hits.orderBy(F.desc(F.round("score", 9)), "id").limit(candidates)
    age = sc.hours_between(F.col("last_confirmed"), as_of())
    weight = sc.fact_freshness(age, F.col("importance"), F.col("confirmation_count")) * F.when(F.col("category") == topic, 1.3).otherwise(1.0) * F.log1p("confirmation_count")
    scored = facts.where("not is_superseded").join(F.broadcast(hits.select("id")), "id").withColumn("score", F.round(weight, 9))
    once = windows.first_by(scored, [F.lower(F.trim("content"))], [F.desc("score"), F.asc("id")])
    packed = windows.prefix_budget(once.withColumn("_all", F.lit(1)), ["_all"], [F.desc("score"), F.asc("id")], word_count(F.col("content")), budget)
    return packed.select("id", "score", "used", "content")
