"""Substring dedup by sliding spans of sentences."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm import textvec
from memloom.llm.common import keep, part_of, table

#: Spans: sentences in a row, two at least, of SEVERAL words or more together; and pieces in a row of LONG words or more.
SEVERAL, LONG = 20, 26
#: Of this many words of a sentence in a row, the one of least hash begins a new piece. A passage of 3 * PIECE + LONG words
#: (50) holds a whole span of pieces wherever its sentences begin, as its pieces depend on its own words but at the edges.
PIECE = 8
#: Documents that one task holds, and their bytes; spans that one task compares.
GROUP_ROWS, GROUP_BYTES, COMPARED = 8_000, 24 << 20, 4_000_000
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True
_LEAST = -(1 << 63)


def sentences(buf: np.ndarray, offsets: np.ndarray) -> tuple[textvec.Words, np.ndarray, np.ndarray]:
    """Words, the first word of each sentence (and one past the last), and each document's first sentence (and one past the
    last). A sentence ends at a word that ends in . ! ? or before a line break."""
    w = textvec.words(buf, offsets)
    n = len(w.starts)
    if not n:
        return w, np.zeros(1, np.int64), np.zeros(len(w.first), np.int64)
    breaks = np.concatenate([[0], np.cumsum(buf == 10)])
    final = _STOP[buf[w.ends - 1]]
    final[:-1] |= breaks[w.starts[1:]] > breaks[w.ends[:-1]]
    final[w.first[1:][w.counts > 0] - 1] = True
    first = np.concatenate([[0], np.flatnonzero(final) + 1])
    return w, first, np.searchsorted(first, w.first)


def pieces(w: textvec.Words, first: np.ndarray, size: int = PIECE) -> np.ndarray:
    """The first word of each piece (and one past the last): where sentences begin, and at the words of least hash of any
    `size` words in a row of one sentence. A sentence of fewer words is one piece, and no piece has more than `size` words."""
    n = len(w.hashes)
    if n < size:
        return first
    order = textvec.mix(w.hashes ^ np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
    sentence = np.repeat(np.arange(len(first) - 1), np.diff(first))
    least = _slide(order, size, np.minimum)
    least[sentence[: len(least)] != sentence[size - 1 :]] = 0
    none = np.zeros(size - 1, np.uint64)
    chosen = _slide(np.concatenate([none, least, none]), size, np.maximum) == order
    chosen[first[:-1]] = True
    return np.append(np.flatnonzero(chosen), n)


def _slide(v: np.ndarray, size: int, of: np.ufunc) -> np.ndarray:
    width = 1
    while width < size:  # overlapping halves
        step = min(width, size - width)
        v = of(v[: len(v) - step], v[step:])
        width += step
    return v


def _runs(first: np.ndarray, several: int) -> tuple[np.ndarray, np.ndarray]:
    """From each sentence on, and up to each, the fewest sentences that are two and have `several` words: the first word of each
    run and one past the last. A repeat of whole sentences that are long enough together is covered from end to end."""
    n = len(first) - 1
    place = np.arange(n)
    stop = np.maximum(np.searchsorted(first, first[:-1] + several), place + 2)
    start = np.minimum(np.searchsorted(first, first[1:] - several, "right") - 1, place - 1)
    on, back = stop <= n, start >= 0
    return np.append(first[:-1][on], first[start[back]]), np.append(first[stop[on]], first[1:][back])


def spans(w: textvec.Words, first: np.ndarray, docs: np.ndarray, several: int, long: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans: first word, one past the last, and two hashes of the words (64 and 32 bits). Runs of several sentences; and from
    every piece on, as many as have `long` words, which find what lies within one or two long sentences."""
    own = lambda a, b: b <= w.first[1:][np.searchsorted(w.first, a, "right") - 1]  # noqa: E731  whether a span lies in one document
    cut = pieces(w, first)
    at = np.searchsorted(cut, cut[:-1] + long)
    a, b = _runs(first, several)
    a, b = np.append(a, cut[:-1][at < len(cut)]), np.append(b, cut[at[at < len(cut)]])
    ok = own(a, b)
    places = np.unique(a[ok] << 32 | b[ok] - a[ok])
    a = places >> 32
    b = a + (places & 0xFFFFFFFF)
    up, down = textvec._powers(len(w.hashes) + 1)

    def hashed(words: np.ndarray) -> np.ndarray:
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)])])
        return textvec.mix((total[b] - total[a]) * down[a] ^ (b - a).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))

    return a, b, hashed(w.hashes), (hashed(textvec.mix(w.hashes ^ np.uint64(0x5851F42D4C957F2D))) >> np.uint64(32)).astype(np.uint32)


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(_LEAST).to_numpy(zero_copy_only=False).astype(np.int64)


def _packed(v: np.ndarray) -> bytes:
    """The values' bytes by place, so that those that are mostly zero lie together and are compressed away."""
    return v.view(np.uint8).reshape(-1, v.itemsize).T.tobytes()


def _unpacked(b: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind)[:, 0]


def _ranks(ids: np.ndarray, ties: np.ndarray, before: tuple[int, int, int] | None = None) -> np.ndarray:
    """Of rows in order of id and tie: the number of lesser ties of the same id. before: id, tie, rank of the row ahead."""
    if not len(ids):
        return np.zeros(0, np.int64)
    new = np.append(before is None or before[0] != ids[0], ids[1:] != ids[:-1])
    step = np.append(not new[0] and before[1] != ties[0], (ties[1:] != ties[:-1]) & ~new[1:]).astype(np.int64)
    total = np.cumsum(step) + (0 if new[0] else before[2])
    start = np.maximum.accumulate(np.where(new, np.arange(len(ids)), -1))
    return total - np.where(start >= 0, total[np.maximum(start, 0)], 0)


def _firsts(buckets: int, several: int, long: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of one group's documents: for each distinct span its first place and whether it occurs again, dealt by the span."""
        parts: list[list[np.ndarray]] = []
        group = None
        for batch in batches:
            if not len(batch):
                continue
            group = batch.column(0)[0].as_py()
            ids, ties = _ids(batch.column(1)), batch.column(2).to_numpy()
            buf, offsets = textvec.raw(batch.column(3))
            for x, y in textvec.slices(buf, offsets):
                w, first, docs = sentences(buf[offsets[x] : offsets[y]], offsets[x : y + 1])
                a, _, h, g = spans(w, first, docs, several, long)
                d = np.searchsorted(w.first, a, "right") - 1
                parts.append([h, g, ids[x:y][d], ties[x:y][d], a - w.first[d]])
        if not parts:
            return
        h, g, ids, ties, at = (np.concatenate(p) for p in zip(*parts, strict=True))
        order = np.lexsort((ties, ids))
        ties[order] = _ranks(ids[order], ties[order])
        order = np.lexsort((at, ties, ids, g, h))
        h, g, ids, ties, at = (c[order] for c in (h, g, ids, ties, at))
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        starts = np.flatnonzero(new)
        last = np.append(starts[1:], len(h)) - 1
        again = (ids[last] != ids[starts]) | (ties[last] != ties[starts]) | (at[last] != at[starts])
        h, g, ids, ties, at = (c[starts] for c in (h, g, ids, ties, at))
        bucket = (h % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((at, ties, ids, bucket))
        cut = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        ends = np.append(cut[1:], len(order))[: len(cut)]
        cols = [[_packed(np.diff(c[order[a:b]], prepend=np.int64(0)) if c is ids else c[order[a:b]]) for a, b in zip(cut, ends, strict=True)] for c in (h, g, ids, ties, at, again.astype(np.uint8))]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[order][cut].astype(np.int32)), pa.array(np.full(len(cut), group, np.int32)), *(pa.array(c, pa.binary()) for c in cols)], names=["bucket", "group", "h", "g", "ids", "ties", "at", "again"])

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one bucket: spans that occur more than once, sent to each group that is to remove them; with the first place over
    all groups for the group that holds it, else with place -1."""
    groups, parts = [], [[], [], [], [], [], []]
    for batch in batches:
        for row in range(len(batch)):
            blobs = [batch.column(c)[row].as_py() for c in range(2, 8)]
            groups.append(np.full(len(blobs[0]) // 8, batch.column(1)[row].as_py(), np.int32))
            for p, b, t in zip(parts, blobs, (np.uint64, np.uint32, np.int64, np.int64, np.int64, np.uint8), strict=True):
                p.append(np.cumsum(_unpacked(b, t)) if p is parts[2] else _unpacked(b, t))
    if not groups:
        return
    group = np.concatenate(groups)
    h, g, ids, ties, at, again = (np.concatenate(p) for p in parts)
    order = np.lexsort((at, ties, ids, g, h))
    h, g, ids, ties, at, again, group = (c[order] for c in (h, g, ids, ties, at, again, group))
    starts = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])]))
    n = np.diff(np.append(starts, len(h)))
    own = np.zeros(len(h), bool)
    own[starts] = True
    more = ~own | (again > 0)  # the first place's group has nothing to remove unless it holds the span again
    h, g, group = h[more], g[more], group[more]
    ids, ties, at = (np.where(own, c, none)[more] for c, none in ((ids, 0), (ties, 0), (at, -1)))
    order = np.argsort(group, kind="stable")
    cut = np.flatnonzero(np.diff(group[order], prepend=-1))
    ends = np.append(cut[1:], len(order))[: len(cut)]
    cols = [[_packed(c[order[a:b]]) for a, b in zip(cut, ends, strict=True)] for c in (h, g, ids, ties, at)]
    yield pa.RecordBatch.from_arrays([pa.array(group[order][cut]), *(pa.array(c, pa.binary()) for c in cols)], names=["_group", "h", "g", "ids", "ties", "at"])


def _found(known: np.ndarray, also: np.ndarray, h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each (h, g) is among the pairs (known, also), which are in order, and where."""
    place = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
    if not len(known):
        return np.zeros(len(h), bool), place
    while True:
        hit = (known[place] == h) & (also[place] == g)
        on = np.flatnonzero(~hit & (place + 1 < len(known)))
        on = on[known[place[on] + 1] == h[on]]  # the same first hash of other words, hardly ever
        if not len(on):
            return hit, place
        place[on] += 1


def _removed(several: int, long: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of one group: first the repeated spans, then its documents."""
        told: list[list[bytes]] = [[], [], [], [], []]
        known: list[np.ndarray] | None = None
        before = None
        for batch in batches:
            kind = batch.column(4).to_numpy(zero_copy_only=False).astype(bool)
            for row in np.flatnonzero(~kind).tolist():
                for p, c in zip(told, range(5, 10), strict=True):
                    p.append(batch.column(c)[row].as_py())
            batch = batch.filter(pa.array(kind))
            if not len(batch):
                continue
            if known is None:
                known = [np.concatenate([np.zeros(0, t), *(_unpacked(b, t) for b in p)]) for p, t in zip(told, (np.uint64, np.uint32, np.int64, np.int64, np.int64), strict=True)]
                order = np.lexsort((known[1], known[0]))
                known = [k[order] for k in known]
            ids, ties = _ids(batch.column(1)), batch.column(2).to_numpy()
            last, ties = ties[-1], _ranks(ids, ties, before)
            before = (ids[-1], last, ties[-1])
            buf, offsets = textvec.raw(batch.column(3))
            for x, y in textvec.slices(buf, offsets):
                part = buf[offsets[x] : offsets[y]]
                w, first, docs = sentences(part, offsets[x : y + 1])
                a, b, h, g = spans(w, first, docs, several, long)
                d = np.searchsorted(w.first, a, "right") - 1
                hit, place = _found(known[0], known[1], h, g)
                if len(known[0]):
                    hit &= ~((known[2][place] == ids[x:y][d]) & (known[3][place] == ties[x:y][d]) & (known[4][place] == a - w.first[d]))
                cover = np.zeros(len(w.hashes) + 1, np.int64)
                np.add.at(cover, a[hit], 1)
                np.add.at(cover, b[hit], -1)
                gone = np.cumsum(cover)[:-1] > 0
                lost = np.concatenate([[0], np.cumsum(np.add.reduceat(gone, first[:-1]) > 0)]) if len(first) > 1 else np.zeros(1, np.int64)
                removed = lost[docs[1:]] - lost[docs[:-1]]
                texts = []
                base = offsets[x]
                for k in range(y - x):
                    begin, stop = offsets[x + k] - base, offsets[x + k + 1] - base
                    raw = part[begin:stop].tobytes()
                    if removed[k]:
                        f, g = w.first[k], w.first[k + 1]
                        edge = np.flatnonzero(np.diff(np.concatenate([[False], gone[f:g], [False]])))
                        mark = np.ones(len(raw), bool)
                        for u, v in edge.reshape(-1, 2).tolist():
                            mark[w.starts[f + u] - begin : (w.starts[f + v] if f + v < g else stop) - begin] = False
                        raw = part[begin:stop][mark].tobytes()
                    texts.append(raw)
                cols = [batch.column(1).slice(x, y - x), pa.array(np.diff(docs)), pa.array(removed), pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array([t.decode() for t in texts])]
                yield pa.RecordBatch.from_arrays(cols, names=["_id", "n_sentences", "n_removed", "kept_sha256", "text"])

    return run


def span_dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", several: int = SEVERAL, long: int = LONG) -> DataFrame:
    """Remove the words that any repeated span covers, but in the span's first place (least id, then position).

    A sentence ends at a word that ends in . ! ? or at a line break. A span is a run of two or more sentences, the shortest
    of `several` words from each sentence on and up to each; longer runs repeat with the shortest ones in them. Beside them,
    sentences are cut into pieces of at most PIECE words, at places that the words alone decide, and pieces in a row up to
    `long` words are spans too: so a repeat of 50 words holds a span even where it lies within one or two long sentences.
    Repeats that are shorter stay: short runs recur in documents that have nothing else in common.

    Spans are equal if their words are (A-Z lower-cased, white space aside); they are compared by 96 hash bits. Returns id,
    n_sentences, n_removed (sentences that lose words), kept_sha256, text.

    Documents are dealt into groups, and each group sends a span once, however often it holds it; so a span of many
    documents costs a row for each group at most.

    Null or empty text: no sentences, text "". A null id is below all others. Rows that share id and text are one document
    and keep the same sentences; rows that share only the id are ordered by a hash of the text. An empty table gives an
    empty table; extra columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_tie"), F.coalesce(text_col, F.lit("")).alias("_text"))
    stats = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("_text")), F.lit(0)).alias("bytes")).first()
    groups = max(part_of(spark, stats["n"], GROUP_ROWS), part_of(spark, stats["bytes"], GROUP_BYTES))
    group = F.pmod(F.xxhash64("_id"), F.lit(groups)).cast("int")
    dealt = rows.select(group.alias("_group"), "_id", "_tie", "_text").repartitionById(groups, F.col("_group"))
    buckets = part_of(spark, stats["bytes"] // 16, COMPARED)  # about a span for 16 bytes
    sent = dealt.mapInArrow(_firsts(buckets, several, long), "bucket int, group int, h binary, g binary, ids binary, ties binary, at binary, again binary")
    told = keep(spark, sent.repartitionById(buckets, F.col("bucket")).mapInArrow(_repeated, "_group int, h binary, g binary, ids binary, ties binary, at binary"))
    nothing = F.lit(None).cast("binary")
    documents = rows.select(group.alias("_group"), "_id", "_tie", "_text", F.lit(True).alias("_doc"), *(nothing.alias(c) for c in ("h", "g", "ids", "ties", "at")))
    answers = told.select("_group", F.lit(None).cast(docs.schema[id_col].dataType).alias("_id"), F.lit(0).cast("long").alias("_tie"), F.lit("").alias("_text"), F.lit(False).alias("_doc"), "h", "g", "ids", "ties", "at")
    both = documents.unionByName(answers).repartitionById(groups, F.col("_group")).sortWithinPartitions("_doc", "_id", "_tie")
    kind = docs.schema[id_col].dataType.simpleString()
    out = both.mapInArrow(_removed(several, long), f"_id {kind}, n_sentences long, n_removed long, kept_sha256 string, text string")
    return out.withColumnRenamed("_id", id_col)


def op6_sentence_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_dedup(spark, table(spark, sf_dir, "documents"))
