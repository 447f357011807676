"""Ranked lexical search: score-at-a-time over impact-ordered postings, segment of documents by segment."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memloom.llm import textvec
from memloom.llm.common import keep, table

TOP = 10
#: Postings of one segment, about 28 bytes each while it is searched.
SEGMENT = 1 << 21
#: Pairs of item and term that one scan of the documents answers; more items are answered in further blocks.
BLOCK = 1 << 20
#: After each round of a search, impacts down to this share of the round's greatest are processed.
STEP = 0.7
#: Groups in which the tasks' best documents of an item are ranked first.
SALTS = 64


def _terms(texts: pa.Array) -> Iterator[tuple[int, int, textvec.Words]]:
    buf, offsets = textvec.raw(texts)
    for i, j in textvec.slices(buf, offsets):
        yield i, j, textvec.words(buf[offsets[i] : offsets[j]], offsets[i : j + 1], ink=textvec.TERM_INK)


def _postings(w: textvec.Words, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, term number and occurrences of each pair with a term of the vocabulary, by document, then term."""
    if not len(w.hashes):
        return (np.zeros(0, np.int64),) * 3
    at = np.minimum(np.searchsorted(vocabulary, w.hashes), len(vocabulary) - 1)
    known = vocabulary[at] == w.hashes
    keys, times = np.unique(w.doc()[known] * len(vocabulary) + at[known], return_counts=True)
    return keys // len(vocabulary), keys % len(vocabulary), times


class Segment:
    """The postings of some documents, twice: by term and falling impact, where equal impacts lie together, and by document."""

    def __init__(self, docs: np.ndarray, terms: np.ndarray, score: np.ndarray, ids: pa.Array, n_terms: int):
        order = np.lexsort((-score, terms))
        self.docs, self.score = docs[order], score[order]
        self.falling = -self.score
        self.bounds = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.keys, self.by_doc, self.ids, self.n_terms = docs * n_terms + terms, score, ids, n_terms
        self.seen = np.zeros(len(ids), np.int64)

    def complete(self, docs: np.ndarray, query: np.ndarray) -> np.ndarray:
        """The whole scores of documents."""
        want = docs[:, None] * self.n_terms + query[None, :]
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.by_doc[at], 0).sum(1)

    def search(self, query: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores, with all that can be among the k best (ties included), by falling impact: a round adds whole
        groups of equal impact to what their documents have. It ends once no document outside can reach the k-th best score
        so far, or `floor` that k documents elsewhere have, by what each term still holds."""
        low, high = self.bounds[query], self.bounds[query + 1]
        query, at, high = query[low < high], low[low < high], high[low < high]
        seen = self.seen
        seen[:] = 0
        rest, best = int(self.score[at].sum()), floor
        while rest and rest >= best:
            open_terms = np.flatnonzero(at < high)
            down_to = int(self.score[at[open_terms]].max() * STEP)
            for t in open_terms.tolist():
                a = int(at[t])
                b = a + int(np.searchsorted(self.falling[a : high[t]], -down_to, "right"))
                seen[self.docs[a:b]] += self.score[a:b]  # a term has a document once
                at[t] = b
            rest = int(self.score[at[at < high]].sum())
            if len(seen) >= k:
                best = max(best, int(np.partition(seen, len(seen) - k)[len(seen) - k]))
        docs = np.flatnonzero((seen > 0) & (seen + rest >= best))
        score = self.complete(docs, query) if rest and len(docs) else seen[docs]
        return docs[score >= best], score[score >= best]


def _first(ids: pa.Array, score: np.ndarray, k: int) -> tuple[pa.Array, np.ndarray]:
    """The k best; equal scores by rising id, a null id first."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        ids, score = ids.filter(pa.array(score >= least)), score[score >= least]
    order = pc.sort_indices(pa.table({"score": score, "id": ids}), sort_keys=[("score", "descending"), ("id", "ascending")], null_placement="at_start")[:k]
    return ids.take(order), score[order.to_numpy()]


def _statistics(texts: DataFrame, sent: Broadcast) -> dict[int, int]:
    """Documents that hold each term of the vocabulary; at -1 the documents with terms, at -2 all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.value[0]
        held, docs, length = np.zeros(len(vocabulary), np.int64), 0, 0
        for batch in batches:
            for _, _, w in _terms(batch.column(0)):
                held += np.bincount(_postings(w, vocabulary)[1], minlength=len(held))
                docs, length = docs + int((w.counts > 0).sum()), length + len(w.hashes)
        terms = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(terms, [-1, -2])), pa.array(np.append(held[terms], [docs, length]))], names=["term", "n"])

    return {r["term"]: r["n"] for r in texts.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}


def _best(texts: DataFrame, sent: Broadcast, kind: str, k: int) -> DataFrame:
    """The best documents of each item in each task: item (its number), id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, queries, weights, docs_n, length = sent.value
        best: list[tuple[pa.Array, np.ndarray] | None] = [None] * len(queries)
        held: list[tuple] = []
        size = 0

        def search() -> None:
            ids = pa.concat_arrays([x[0] for x in held])
            start = np.cumsum([0, *(len(x[0]) for x in held[:-1])])
            docs = np.concatenate([x[1] + s for x, s in zip(held, start, strict=True)])
            segment = Segment(docs, np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held]), ids, len(vocabulary))
            for n, query in enumerate(queries):
                own = best[n]
                found, score = segment.search(query, k, int(own[1][-1]) if own and len(own[1]) == k else 1)
                if len(found):
                    more = ids.take(pa.array(found))
                    best[n] = _first(pa.concat_arrays([own[0], more]), np.concatenate([own[1], score]), k) if own else _first(more, score, k)
            held.clear()

        for batch in batches:
            for i, j, w in _terms(batch.column(0)):
                docs, terms, times = _postings(w, vocabulary)
                m = 10 + 90 * w.counts.astype(np.int64) * docs_n // length
                held.append((batch.column(1).slice(i, j - i), docs, terms, weights[terms] * (1_000_000_000 * times // (1000 * times + 8 * m[docs]))))
                size += len(docs)
                if size >= SEGMENT:
                    search()
                    size = 0
        if size:
            search()
        for n, own in enumerate(best):
            if own:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own[1]), n)), own[0], pa.array(own[1])], names=["item", "id", "score"])

    return texts.mapInArrow(run, f"item long, id {kind}, score long")


def ranked_search(spark: SparkSession, docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The k documents of highest score above 0 for each item: item, rank (from 1), id, score; equal scores by rising id.

    Terms are runs of digits, ASCII letters (lower-cased) and non-ASCII characters. A term that n of all N documents with terms
    hold weighs w = floor(1000 ln((2 N + 2) / (2 n + 1))); its impact in a document is 10^9 tf div (1000 tf + 8 m), where m is
    10 + 90 times the document's length over the mean; a score sums w times impact over the item's distinct terms.

    Two scans of the texts: the first counts documents per term of the items, the second builds the postings of about SEGMENT
    pairs at a time and searches them score-at-a-time: postings of equal impact are one group, groups are processed from the
    highest down, and a search stops when the terms' next impacts prove that no other document can be among the best; only the
    documents still possible get their whole scores. A segment starts from the k-th best score of its task. Each task gives k
    rows for an item at most, which are ranked in two steps. Nothing of the postings is shuffled or stored.

    Items are sent to all tasks in blocks of about BLOCK terms, whatever their number. Null, empty texts and texts without terms
    are never found and count in no statistic; items without terms have no rows. Repeated rows are documents of their own; a
    null id comes first among equal scores. Repeated items are ranked each by itself. Extra columns are not read.
    """
    texts = docs.select(F.col(text_col).alias("_text"), F.col(id_col).alias("_id"))
    kind, item_kind = texts.schema["_id"].dataType.simpleString(), items.schema[item_col].dataType
    asked = items.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    # a term takes two bytes with its separator, so there are no more than this
    blocks = max(1, -(-int(asked.agg(F.sum((F.octet_length("text") + 1) / 2).alias("n")).first()["n"] or 0) // (3 * BLOCK)))
    asked = asked.withColumn("_block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    out = []
    for block in range(blocks):
        rows = asked.where(F.col("_block") == block).select("item", "text").collect()
        words = [w.hashes[a:b] for _, _, w in _terms(pa.array([r["text"] for r in rows], pa.string())) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        vocabulary = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
        names = spark.createDataFrame([(n, r["item"]) for n, r in enumerate(rows)], f"item long, `{item_col}` {item_kind.simpleString()}")
        if not len(vocabulary):
            out.append(names.select(item_col, F.lit(1).alias("rank"), F.lit(None).cast(kind).alias(id_col), F.lit(0).cast("long").alias("score")).where("false"))
            continue
        queries = [np.searchsorted(vocabulary, np.unique(h)) for h in words]
        counts = _statistics(texts, spark.sparkContext.broadcast((vocabulary,)))
        n, length = counts.get(-1, 0), counts.get(-2, 0)
        weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * counts.get(t, 0) + 1))) for t in range(len(vocabulary))], np.int64)
        best = _best(texts, spark.sparkContext.broadcast((vocabulary, queries, weights, n, max(length, 1))), kind, k)
        rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc("id")))
        best = best.withColumn("_salt", F.spark_partition_id() % SALTS)
        best = best.withColumn("rank", rank("item", "_salt")).where(F.col("rank") <= k).withColumn("rank", rank("item")).where(F.col("rank") <= k)
        out.append(best.join(names, "item").select(item_col, "rank", F.col("id").alias(id_col), "score"))
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0] if len(out) == 1 else keep(spark, out[0])


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), tf AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM d) GROUP BY doc_id, t),
size AS (SELECT doc_id, len(w) AS n FROM d WHERE len(w) > 0), total AS (SELECT count(*) AS all_docs, sum(n)::BIGINT AS all_terms FROM size),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t), asked AS (SELECT DISTINCT item_id, unnest({_WORDS}) AS t FROM benchmark),
part AS (SELECT item_id, doc_id, floor(1000 * ln((2 * all_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * all_docs) // all_terms)))) AS score
         FROM asked JOIN df USING (t) JOIN tf USING (t) JOIN size USING (doc_id), total),
scored AS (SELECT item_id, doc_id, sum(score)::BIGINT AS score FROM part GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, score FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0) WHERE rank <= {TOP}
"""
