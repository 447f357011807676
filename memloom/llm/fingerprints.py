"""Document fingerprints from closed syncmers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memloom.llm import textvec
from memloom.llm.common import part_of, table

#: A k-mer of K bytes is an anchor if the least hash of its substrings of S bytes lies at one of its edges.
K, S = 11, 5
#: Documents that one task holds in order.
RANGE = 20_000
_LEAST = -(1 << 63)


def _inner(buf: np.ndarray, s: int) -> np.ndarray:
    inner = np.zeros(max(0, len(buf) - s + 1), np.uint64)
    for i in range(s):
        inner |= buf[i : i + len(inner)].astype(np.uint64) << np.uint64(8 * i)
    return inner * np.uint64(0x9E3779B97F4A7C15)


def inner_order(buf: np.ndarray, s: int = S) -> np.ndarray:
    """The order of the substrings of s bytes: a hash of each."""
    inner = _inner(buf, s)
    return ((inner ^ (inner >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32)


def syncmers(buf: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the closed syncmers of the bytes. Whether a k-mer is chosen depends on its own bytes alone."""
    n = len(buf) - k + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    inner, order = _inner(buf, s), inner_order(buf, s)
    w, least, width = k - s + 1, order, 1
    while width < w:  # least of w in a row, from overlapping halves
        step = min(width, w - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    at = np.flatnonzero((least == order[:n]) | (least == order[w - 1 : w - 1 + n]))
    h = np.zeros(len(at), np.uint64)
    for i in (*range(0, k - s, s), k - s):
        h = textvec.mix(h ^ inner[np.minimum(at + i, len(inner) - 1)])
    return at, (h >> np.uint64(32)).astype(np.uint32)


def anchors(buf: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The fingerprint of each text: where its anchors begin (bytes from the text's start, rising) and their hashes. A text
    without anchors has the hash of all its bytes as its only anchor, at 0; an empty text has none."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for i, j in textvec.slices(buf, offsets):
        at, h = syncmers(buf[offsets[i] : offsets[j]])
        at = at + offsets[i]
        low = np.searchsorted(at, offsets[i:j])
        high = np.searchsorted(at, offsets[i + 1 : j + 1] - K, "right")
        for d, a, b in zip(range(i, j), low.tolist(), high.tolist(), strict=True):
            place, own = (at[a:b] - offsets[d]).astype(np.int32), h[a:b]
            if not len(own) and offsets[d + 1] > offsets[d]:
                place, own = np.zeros(1, np.int32), np.frombuffer(hashlib.sha256(buf[offsets[d] : offsets[d + 1]].tobytes()).digest()[:4], ">u4").astype(np.uint32)
            out.append((place, own))
    return out


def text_form(hashes: np.ndarray) -> str:
    return hashes.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two sets of anchor hashes (rising, distinct). Two empty ones: 1."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _places(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    ends = np.cumsum([0, *(len(p) for p, _ in found)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *(p for p, _ in found)])))


def fingerprint(docs: DataFrame, text_col: str = "text", places_col: str | None = None) -> DataFrame:
    """Adds fingerprint (hexadecimal, 8 digits for each anchor in the order of the text) and, where places_col names it, a
    column of the bytes where they begin. Null text counts as empty; empty texts have "" and no places.
    Any ids, repeated rows and extra columns pass through; an empty table gives an empty table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = anchors(*textvec.raw(batch.column(batch.schema.get_field_index(text_col))))
            made = [pa.array([text_form(h) for _, h in found], pa.string()), _places(found)][: len(added)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *(f.name for f in added)])

    added = [T.StructField("fingerprint", T.StringType())] + ([T.StructField(places_col, T.ArrayType(T.IntegerType()))] if places_col else [])
    docs = docs.drop(*(f.name for f in added))
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def with_next(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal documents into ranges of ids, in falling order within each, with each range's successor: the columns _bucket,
    _id, _halo, _text. The successor of a range is a copy (_halo true) of the first row of the next range that has rows.

    Ids are cut at quantiles; the driver holds one number for each range.
    Null ids come last; rows that share an id are ordered by a hash of their text.
    """
    ids = docs.select(F.coalesce(F.col(id_col), F.lit(_LEAST)).alias("_id"))
    rows = ids.count()
    n = part_of(spark, rows, RANGE)
    cuts = sorted(set(ids.select(F.percentile_approx("_id", [i / n for i in range(1, n)], 10_000)).first()[0] or [])) if n > 1 else []
    at = np.array(cuts, np.int64)

    def bucket(values: np.ndarray) -> np.ndarray:
        return np.searchsorted(at, values, "right").astype(np.int32)

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(0).to_numpy()
            b = bucket(v)
            order = np.lexsort((v, b))
            last = np.flatnonzero(np.diff(b[order], append=-1))
            yield pa.RecordBatch.from_arrays([pa.array(b[order][last]), pa.array(v[order][last])], names=["b", "top"])

    top = {r["b"]: r["top"] for r in ids.mapInArrow(tops, "b int, top long").groupBy("b").agg(F.max("top").alias("top")).collect()}  # n rows at most
    full = sorted(top)
    above = {top[b]: full[(i + 1) % len(full)] for i, b in enumerate(full)}  # the largest id of a range follows the range above

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, tie = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            copies: dict[int, int] = {}
            for i in np.flatnonzero(np.isin(v, list(above))).tolist():
                if int(v[i]) not in copies or tie[i] < tie[copies[int(v[i])]]:
                    copies[int(v[i])] = i
            take = pa.array([*range(len(v)), *copies.values()], pa.int64())
            b = np.concatenate([bucket(v), np.array([above[x] for x in copies], np.int32)])
            halo = np.arange(len(b)) >= len(v)
            cols = [batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take)]
            yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(halo), *cols], names=["_bucket", "_halo", "_id", "_text", "_tie"])

    light = docs.select(F.coalesce(F.col(id_col), F.lit(_LEAST)).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"), F.xxhash64(text_col).alias("_tie"))
    dealt = light.mapInArrow(deal, "_bucket int, _halo boolean, _id long, _text string, _tie long")
    return dealt.repartitionById(len(cuts) + 1, F.col("_bucket")).sortWithinPartitions("_bucket", "_halo", F.desc("_id"), "_tie")


def edited_fingerprints(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How a fingerprint holds when the last third of the text is replaced by the head of the next document (falling ids, after
    the last the first): id, n_chars, edited_sha256, fingerprint, places, edited_fingerprint, edited_places, near_edited, near_next. Fingerprints hold all
    anchors, with the bytes where they begin in places, and the likenesses are exact over them.

    Null text: empty. Null id: the last document, returned with a null id. Repeated ids follow one another by a hash of the
    text. A single document follows itself. An empty table gives an empty table; extra columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        halo_of: int | None = None

        for batch in batches:
            rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True))
            pairs = []
            for row in rows:
                if held is not None and held[0] == row[0]:
                    if halo_of != row[0]:
                        pairs.append((held, row))
                    if row[1]:
                        halo_of = row[0]
                held = row
            for i in range(0, len(pairs), 256):
                yield _finished(pairs[i : i + 256], id_col)

    out = f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, places array<int>, edited_fingerprint string, edited_places array<int>, near_edited double, near_next double"
    return with_next(spark, docs, id_col, text_col).mapInArrow(run, out)


def _anchors(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    return anchors(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64))


def _finished(pairs: list[tuple[tuple, tuple]], id_col: str) -> pa.RecordBatch:
    edited = []
    for (_, _, _, text), (_, _, _, follows) in pairs:
        cut = len(text) // 3
        edited.append((text[: len(text) - cut] + follows[:cut]).encode())
    own, after, found = (_anchors(texts) for texts in ([a[3].encode() for a, _ in pairs], [b[3].encode() for _, b in pairs], edited))
    sets, next_sets, edited_sets = ([np.unique(h) for _, h in x] for x in (own, after, found))
    cols = [
        pa.array([None if a[2] == _LEAST else a[2] for a, _ in pairs], pa.int64()),
        pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
        pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
        pa.array([text_form(h) for _, h in own]),
        _places(own),
        pa.array([text_form(h) for _, h in found]),
        _places(found),
        pa.array([likeness(x, y) for x, y in zip(sets, edited_sets, strict=True)], pa.float64()),
        pa.array([likeness(x, y) for x, y in zip(sets, next_sets, strict=True)], pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(cols, names=[id_col, "n_chars", "edited_sha256", "fingerprint", "places", "edited_fingerprint", "edited_places", "near_edited", "near_next"])


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(spark, table(spark, sf_dir, "documents"))
