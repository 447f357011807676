"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all items, run once over every text."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm import textvec
from memloom.llm.common import keep, table

WINDOW = 10
#: Windows that one automaton holds: about 200 MB in a worker. More windows make more automata, each with its own scan.
WINDOWS = 400_000

_automata: dict[str, tuple] = {}


def _patterns(rows: list[tuple[str, str | None]], window: int) -> tuple[np.ndarray, list[tuple[int, ...]], list[list[str]]]:
    """The vocabulary (sorted hashes), each distinct window as numbers of words (from 1), and the items that hold it."""
    buf, offsets = textvec.raw(pa.array([t for _, t in rows], pa.string()))
    w = textvec.words(buf, offsets, ink=textvec.TERM_INK)
    vocabulary, numbers = np.unique(w.hashes, return_inverse=True)
    numbers = (numbers + 1).tolist()
    owners: dict[tuple[int, ...], set[str]] = {}
    for k, (item, _) in enumerate(rows):
        own = tuple(numbers[w.first[k] : w.first[k + 1]])
        for i in range(max(1, len(own) - window + 1) if own else 0):
            owners.setdefault(own[i : i + window], set()).add(item)
    return vocabulary, list(owners), [sorted(x) for x in owners.values()]


def _automaton(sent: Broadcast, name: str) -> tuple:
    """Built once in a worker, for the patterns that were sent last."""
    if name not in _automata:
        vocabulary, patterns, owners = sent.value
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for n, pattern in enumerate(patterns):
            automaton.add_word(pattern, n)
        automaton.make_automaton()
        _automata.clear()
        _automata[name] = automaton, vocabulary, np.array([len(p) for p in patterns], np.int64), owners
    return _automata[name]


def _hits(w: textvec.Words, automaton, vocabulary: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which words are inside a window's occurrence; of each occurrence, the document and the window."""
    at = np.searchsorted(vocabulary, w.hashes)
    known = vocabulary[np.minimum(at, len(vocabulary) - 1)] == w.hashes
    doc = w.doc()
    place = np.arange(len(doc)) + doc  # a zero after each document: no window crosses it
    text = np.zeros(len(doc) + len(w.first), np.int64)
    text[place] = np.where(known, at + 1, 0)
    found = np.array(list(automaton.iter(tuple(text.tolist()))), np.int64).reshape(-1, 2)
    end = np.searchsorted(place, found[:, 0])
    step = np.zeros(len(doc) + 1, np.int64)
    np.add.at(step, end - lengths[found[:, 1]] + 1, 1)
    np.add.at(step, end + 1, -1)
    return np.cumsum(step[:-1]) > 0, doc[end], found[:, 1]


def _scan(docs: DataFrame, sent: Broadcast, kind: str) -> DataFrame:
    """_id, _hash -> n_words, items, spans by the windows of one automaton."""
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, vocabulary, lengths, owners = _automaton(sent, name)
        for batch in batches:
            buf, offsets = textvec.raw(batch.column(2))
            for i, j in textvec.slices(buf, offsets):
                part = buf[offsets[i] : offsets[j]]
                w = textvec.words(part, offsets[i : j + 1], ink=textvec.TERM_INK)
                items: list[list[str]] = [[] for _ in range(j - i)]
                spans: list[list[dict]] = [[] for _ in range(j - i)]
                hit, doc, window = _hits(w, automaton, vocabulary, lengths) if len(w.hashes) and len(lengths) else (np.zeros(0, bool),) * 3
                if hit.any():
                    for d in np.unique(doc).tolist():
                        items[d] = sorted({x for n in np.unique(window[doc == d]).tolist() for x in owners[n]})
                    of = w.doc()
                    new = np.append(True, of[1:] != of[:-1])
                    first = np.flatnonzero(hit & (new | ~np.append(False, hit[:-1])))
                    last = np.flatnonzero(hit & (np.append(new[1:], True) | ~np.append(hit[1:], False)))
                    chars = np.append(0, np.cumsum((part & 0xC0) != 0x80))  # code points before each byte
                    base = chars[offsets[i : j + 1] - offsets[i]]
                    for a, b, d in zip(first.tolist(), last.tolist(), of[first].tolist(), strict=True):
                        spans[d].append({"first": a - int(w.first[d]), "last": b - int(w.first[d]), "start": int(chars[w.starts[a]] - base[d]), "stop": int(chars[w.ends[b]] - base[d])})
                cols = [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(w.counts, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, _SPANS)]
                yield pa.RecordBatch.from_arrays(cols, names=["_id", "_hash", "n_words", "items", "spans"])

    return docs.mapInArrow(run, f"_id {kind}, _hash long, n_words long, items array<string>, spans array<struct<first:long,last:long,start:long,stop:long>>")


_SPANS = pa.list_(pa.struct([(n, pa.int64()) for n in ("first", "last", "start", "stop")]))


def _merged(spans: Column) -> Column:
    """Runs of hit words from several automata: runs that overlap or touch become one."""

    def step(done: Column, x: Column) -> Column:
        top = F.element_at(done, -1)
        longer = F.struct(top["first"].alias("first"), F.greatest(top["last"], x["last"]).alias("last"), top["start"].alias("start"), F.greatest(top["stop"], x["stop"]).alias("stop"))
        return F.when((F.size(done) > 0) & (F.get(done, F.size(done) - 1)["last"] + 1 >= x["first"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(spans), F.slice(spans, 1, 0), step)


def decontaminate(spark: SparkSession, docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Find the passages that documents share with benchmark items. Returns for each row: id, n_words, n_hit, items (array of the
    ids of items with an occurring window, as strings in order), spans (array of struct(first, last: words; start, stop: code
    points of the original text, the end exclusive) of the runs of hit words).

    Words are runs of digits, ASCII letters (lower-cased) and non-ASCII characters. A window is `window` consecutive words of an
    item; an item of fewer words, but not none, is one window. The windows of all items make one automaton over numbers of
    words, which runs once over each text; of more than WINDOWS words of items, each further automaton has a scan of its own and
    rows that it hits are merged by id and text.

    Null or empty texts have no words and no hits; items without words match nothing. A null item id counts as the id "null", a
    repeated one once. Null ids and repeated rows of documents give one result each. Without items no word is hit. An empty table
    gives an empty table; extra columns are not read.
    """
    light = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"), F.col(text_col).alias("_text"))
    kind = light.schema["_id"].dataType.simpleString()
    rows = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(item_text_col).alias("text"))
    # an ASCII word takes two bytes with its separator, so there are no more words than this
    words = rows.agg(F.sum((F.octet_length("text") + 1) / 2).alias("n")).first()["n"] or 0
    groups = max(1, -(-int(words) // (3 * WINDOWS)))
    rows = rows.withColumn("_group", F.pmod(F.xxhash64("item", "text"), F.lit(groups)))
    scans = []
    for g in range(groups):
        sent = spark.sparkContext.broadcast(_patterns([(r["item"], r["text"]) for r in rows.where(F.col("_group") == g).collect()], window))
        scans.append(_scan(light, sent, kind))
    out = scans[0]
    if len(scans) > 1:
        more = scans[1]
        for s in scans[2:]:
            more = more.unionByName(s)
        more = keep(spark, more.where(F.size("spans") > 0))
        more = more.groupBy(F.col("_id").alias("_mid"), F.col("_hash").alias("_mhash")).agg(F.flatten(F.collect_set("items")).alias("_items"), F.flatten(F.collect_set("spans")).alias("_spans"))
        out = out.join(more, F.col("_id").eqNullSafe(F.col("_mid")) & (F.col("_hash") == F.col("_mhash")), "left")
        every = F.concat("items", F.coalesce("_items", F.array().cast("array<string>")))
        runs = F.concat("spans", F.coalesce("_spans", F.slice("spans", 1, 0)))
        out = out.select("_id", "n_words", F.array_sort(F.array_distinct(every)).alias("items"), _merged(runs).alias("spans"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["last"] - x["first"] + 1)
    return out.select(F.col("_id").alias(id_col), "n_words", hit.alias("n_hit"), "items", "spans")


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"].cast("string"), x["stop"].cast("string"))), ",")
    ids = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), spans.alias("spans"))


SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS k, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS words
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
run AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS words
        FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win))),
met AS (SELECT doc_id, i, run.k, item_id FROM run JOIN win ON run.words = win.words AND run.k = win.k),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM met)) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM met) GROUP BY doc_id),
mark AS (SELECT doc_id, p FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM met))),
chars AS (SELECT doc_id, p, c FROM (SELECT doc_id, generate_subscripts(s, 1) AS p, unnest(s) AS c FROM (
        SELECT doc_id, list_transform(regexp_extract_all(text, '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: {{'n': length(x), 'w': length(regexp_extract(x, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))}}) AS s
        FROM documents WHERE doc_id IN (SELECT doc_id FROM hits)))),
stops AS (SELECT doc_id, p, sum(c.n) OVER (PARTITION BY doc_id ORDER BY p) AS stop, c.w AS w FROM chars),
runs AS (SELECT doc_id, min(stop - w)::BIGINT AS start, max(stop)::BIGINT AS stop
         FROM (SELECT mark.*, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS island FROM mark) m JOIN stops USING (doc_id, p) GROUP BY doc_id, island),
spans AS (SELECT doc_id, string_agg(start || ':' || stop, ',' ORDER BY start) AS spans FROM runs GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated,
       coalesce(spans, '') AS spans
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN ids USING (doc_id) LEFT JOIN spans USING (doc_id)
"""
