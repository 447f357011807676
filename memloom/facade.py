"""A thin object over the stores: recall, context for a prompt, learning. Every method gives a DataFrame or a new Memory."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions.text import tokens_by_length
from memloom.operators import learning, search, stores, windows
from memloom.plans.recall import budgeted_recall

#: Decides how many tokens a text takes; gives a column.
Counter = Callable[[Column], Column]


@dataclass(frozen=True)
class Memory:
    """facts and episodes as in plans.views. `count` is the token counter; `scorer` re-scores hits of a search, where given."""

    spark: SparkSession
    facts: DataFrame
    episodes: DataFrame
    count: Counter = tokens_by_length
    scorer: Callable[[DataFrame], DataFrame] | None = None

    def remember(self, query: str, limit: int = 5) -> DataFrame:
        """Facts and episodes that match the query best: kind, id, score. An empty query has no words and finds nothing."""
        words = search.expanded(query.split())
        if not words:
            return self.facts.select(F.lit("fact").alias("kind"), "id", F.lit(0.0).alias("score")).limit(0)
        parts = []
        for kind, df, text in (("fact", self.facts.where("not is_superseded"), "content"), ("episode", self.episodes, "summary")):
            hits = search.bm25(self.spark, df, "id", text, words)
            hits = self.scorer(hits) if self.scorer else hits
            parts.append(hits.orderBy(F.desc(F.round("score", 9)), "id").limit(limit).select(F.lit(kind).alias("kind"), "id", "score"))
        return parts[0].unionAll(parts[1])

    def recent(self, limit: int = 10) -> DataFrame:
        return stores.page(self.episodes, [F.desc("started_at"), F.asc("id")], limit)

    def profile(self, per_type: int = 5) -> DataFrame:
        """The most important facts of each type."""
        return windows.top_per(self.facts.where("not is_superseded"), ["fact_type"], [F.desc("importance"), F.asc("id")], per_type).select("fact_type", "place", "id", "content")

    def injection(self, query: str, topic: str | None = None, budget: int = 200, header: str = "What is known:") -> DataFrame:
        """One row: the text for a prompt, a line for each recalled fact, and its tokens. The recalled facts fit a budget."""
        lines = budgeted_recall(self.spark, self.facts, query, topic, budget)
        row = lines.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "id", "content"))).alias("l"))
        text = F.concat(F.lit(header), F.array_join(F.transform("l", lambda x: F.concat(F.lit("\n- "), x["content"])), ""))
        return row.select(F.when(F.size("l") > 0, text).otherwise("").alias("text")).withColumn("tokens", self.count(F.col("text")))

    def usage(self) -> DataFrame:
        """Tokens of either store."""
        part = lambda kind, df, text: df.agg(F.coalesce(F.sum(self.count(F.col(text))), F.lit(0)).alias("tokens")).select(F.lit(kind).alias("kind"), "tokens")
        return part("fact", self.facts, "content").unionAll(part("episode", self.episodes, "summary"))

    def learn(self, rows: DataFrame, threshold: float = 0.75) -> Memory:
        """A memory whose facts are confirmed by, or extended with, rows (id, content); other columns of new facts are null."""
        grown = learning.insert_or_confirm(self.facts.select("id", "content", "confidence", "confirmation_count"), rows, threshold)
        rest = self.facts.drop("content", "confidence", "confirmation_count")
        out = grown.join(rest, "id", "left").withColumn("is_superseded", F.coalesce("is_superseded", F.lit(False)))
        return replace(self, facts=out.select(*self.facts.columns))

    def forget(self, ids: DataFrame) -> Memory:
        """A memory in which the facts are marked superseded, with confidence 0."""
        return replace(self, facts=stores.soft_delete(self.facts, ids, "id", {"is_superseded": F.lit(True), "confidence": F.lit(0.0)}))
