"""Stored indexes: postings of words and sparse text vectors in bucketed Parquet tables, kept up by commits.

A search reads the buckets of the words or slots that it asks for, and of these the row groups whose word range fits. New rows
and deletions are commits of their own on top; rows that a later commit replaces or deletes are left out when they are read,
until the index is compacted.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions.text import words
from memloom.operators import search, vectors
from memloom.operators.pairs import term_counts
from memloom.sources.versions import Conflict, Versions

#: Rows of postings for each bucket, and the fewest and most buckets.
PER_BUCKET, LEAST, MOST = 4_000_000, 16, 4_096
#: Leading letters of a word that name its bucket; shorter prefixes look into all buckets.
LEAD = 2
#: Slots of a text vector that share a folder.
SLOT_GROUP = 8


def bucket_of(term: Column, buckets: int) -> Column:
    return (F.crc32(F.substring(term, 1, LEAD).cast("binary")) % buckets).cast("int")


def _buckets(prefixes: Sequence[str], buckets: int) -> list[int] | None:
    """The buckets of words with one of the prefixes; None for all."""
    if any(len(p) < LEAD for p in prefixes):
        return None
    return sorted({zlib.crc32(p[:LEAD].encode()) % buckets for p in prefixes})


class TextIndex:
    """Postings (word, id, occurrences, length of the row) of a table's texts below a folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.versions = spark, Versions(spark, path)

    @property
    def built(self) -> bool:
        return self.versions.latest() > 0

    def _write(self, rows: DataFrame, buckets: int) -> list[tuple[str, str]]:
        told = rows.select("id", F.explode("w").alias("term"), F.size("w").alias("len")).groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"))
        told = told.withColumn("bucket", bucket_of(F.col("term"), buckets)).repartitionByRange("bucket", "term", "id").sortWithinPartitions("bucket", "term", "id")
        return [self.versions.write("postings", told, ("bucket",)), self.versions.write("sizes", rows.select("id", F.size("w").alias("len")))]

    @staticmethod
    def _told(rows: DataFrame, key: str, text: str) -> DataFrame:
        return rows.select(F.col(key).alias("id"), words(F.col(text)).alias("w"))

    def _sums(self, sizes: DataFrame) -> tuple[int, int]:
        got = sizes.agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("length")).first()
        return got["n"], got["length"]

    def build(self, rows: DataFrame, key: str, text: str) -> int:
        """Index a whole table anew; ids are unique. A null text is a row without words."""
        told = self._told(rows, key, text)
        n, length = self._sums(told.select(F.size("w").alias("len")))
        buckets = min(MOST, max(LEAST, length // PER_BUCKET))
        return self.versions.commit(self._write(told, buckets), replace=True, note="build", meta={"n": n, "length": length, "buckets": buckets})

    def _live(self, rows: DataFrame, version: int | None = None) -> DataFrame:
        gone = self.versions.read("gone", version, "_gone")
        return rows.drop("_of") if gone is None else self.versions.without(rows, gone)

    def _change(self, ids: DataFrame, told: DataFrame | None) -> int:
        """Rows go, others come. What the index holds of them is counted out, so the statistics stay exact; a writer that
        committed meanwhile makes this one count again."""
        ids = ids.distinct()
        parts = [self.versions.write("gone", ids)]
        new = (0, 0)
        if told is not None:
            parts += self._write(told, self.versions.entry()["meta"]["buckets"])
            new = self._sums(told.select(F.size("w").alias("len")))
        while True:
            entry = self.versions.entry()
            held = self._live(self.versions.read("sizes", entry["version"], "_of"), entry["version"])
            old = self._sums(held.join(ids, "id", "left_semi"))
            meta = {"n": entry["meta"]["n"] - old[0] + new[0], "length": entry["meta"]["length"] - old[1] + new[1]}
            try:
                return self.versions.commit(parts, note="upsert" if told is not None else "delete", meta=meta, expected=entry["version"])
            except Conflict:
                continue

    def upsert(self, rows: DataFrame, key: str, text: str) -> int:
        """New texts for ids, known or not; ids are unique among the rows."""
        told = self._told(rows, key, text)
        return self._change(told.select("id"), told)

    def delete(self, ids: DataFrame, key: str) -> int:
        return self._change(ids.select(F.col(key).alias("id")), None)

    def compact(self) -> int:
        """Write what is live as one commit; readers of older versions keep theirs until these are forgotten."""
        entry = self.versions.entry()
        read = lambda kind: self._live(self.versions.read(kind, entry["version"], "_of"), entry["version"])
        postings = read("postings").select("id", "term", "tf", "len", "bucket").repartitionByRange("bucket", "term", "id").sortWithinPartitions("bucket", "term", "id")
        parts = [self.versions.write("postings", postings, ("bucket",)), self.versions.write("sizes", read("sizes"))]
        return self.versions.commit(parts, replace=True, note="compact", meta=entry["meta"], expected=entry["version"])

    def hits(self, prefixes: Sequence[str]) -> DataFrame:
        """Occurrences of words with each prefix per row: id, prefix, tf, len. Reads the prefixes' buckets alone."""
        entry = self.versions.entry()
        rows = self.versions.read("postings", entry["version"], "_of")
        wanted = _buckets(prefixes, entry["meta"]["buckets"])
        rows = rows if wanted is None else rows.where(F.col("bucket").isin(wanted))
        some = F.lit(False)
        for p in prefixes:
            some = some | F.startswith("term", F.lit(p))
        asked = F.explode(F.filter(F.array(*map(F.lit, prefixes)), lambda p: F.startswith("term", p)))
        live = self._live(rows.where(some).select("id", "term", "tf", "len", "_of"), entry["version"])
        return live.withColumn("prefix", asked).groupBy("id", "prefix").agg(F.sum("tf").alias("tf"), F.first("len").alias("len"))

    def bm25(self, prefixes: Sequence[str]) -> DataFrame:
        """As search.bm25 over the rows that are indexed now: id, score."""
        meta = self.versions.entry()["meta"]
        return search.bm25_of(self.hits(list(dict.fromkeys(prefixes))), F.lit(meta["n"]), F.lit(meta["length"] / max(meta["n"], 1)))


class VectorIndex:
    """Sparse text vectors (id, slot, weight) by slot, and the term weights that queries' vectors are made of."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.versions = spark, Versions(spark, path)

    @property
    def built(self) -> bool:
        return self.versions.latest() > 0

    def build(self, rows: DataFrame, key: str, text: str) -> int:
        known = vectors.idf(term_counts(rows, key, text), rows)
        known = known.withColumn("bucket", bucket_of(F.col("term"), LEAST)).repartition("bucket").sortWithinPartitions("term")
        own = vectors.tfidf(rows, key, text).withColumn("group", F.floor(F.col("slot") / SLOT_GROUP).cast("int"))
        own = own.repartitionByRange("group", "slot", "id").sortWithinPartitions("group", "slot")
        return self.versions.commit([self.versions.write("idf", known, ("bucket",)), self.versions.write("vectors", own, ("group",))], replace=True, note="build")

    def vectors(self) -> DataFrame:
        return self.versions.read("vectors").drop("group")

    def embed(self, rows: DataFrame, key: str, text: str) -> DataFrame:
        """Vectors of other texts by the stored weights: reads the buckets of their words, which a few queries have few of."""
        counts = term_counts(rows, key, text).withColumn("bucket", bucket_of(F.col("term"), LEAST))
        known = self.versions.read("idf").join(F.broadcast(counts), ["bucket", "term"])  # a few queries
        return vectors.unit(known.groupBy("id", vectors.slot(F.col("term")).alias("slot")).agg(F.sum(F.col("tf") * F.col("idf")).alias("weight")))

    def nearest(self, queries: DataFrame, k: int) -> DataFrame:
        """For each of a few queries (id, slot, weight) the k stored vectors of greatest cosine, from the slots that they hold."""
        slots = sorted(r["slot"] for r in queries.select("slot").distinct().collect())  # SLOTS at most
        store = self.versions.read("vectors").where(F.col("group").isin(sorted({s // SLOT_GROUP for s in slots})) & F.col("slot").isin(slots))
        return vectors.nearest(queries, store.drop("group"), k)
