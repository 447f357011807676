"""All pairs of rows by their words, in blocks of matrix products.

Rows are packed into chunks, and each two chunks meet once in Spark's cartesian product, which reads them where they are written:
nothing is shuffled for a pair, and a task holds two chunks and a few matrices of CHUNK times CHUNK numbers. The HEAD most
frequent words are columns of dense matrices, the others meet where both chunks hold them, so all sums are exact. The work
grows with the square of the rows, some 10 to 50 ns a pair; what comes out are the pairs that a rule keeps.

Words are compared by 64-bit hashes. Ids are whole numbers; pairs are named with the lesser id first, rows of one id are no pair.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.session import keep

#: Words with columns of their own; rows of a chunk, and of a part of the packed table; meetings of rarer words looked at at once.
HEAD, CHUNK, PART, MET = 128, 2_048, 16_384, 1 << 22
#: Pieces that small tables are cut into, and rows from which a further one pays.
PIECES, LEAST = 8, 512
#: 32-bit floats hold all whole numbers below.
WHOLE = 1 << 24

FIELDS = "chunk long, mark boolean, ids binary, extra binary, lengths binary, keys binary, counts binary"


class Packed(NamedTuple):
    """Chunks in the shared folder and the keys of the most frequent words, sorted."""

    chunks: DataFrame
    head: np.ndarray
    parts: int


def hashed(words: Column) -> Column:
    """The keys of an array of words."""
    return F.transform(words, lambda w: F.xxhash64(w))


def slotted(words: Column) -> Column:
    """Keys from the words' MD5, whose upper 32 bits tell the slots of vectors."""
    half = lambda w, at: F.conv(F.substring(F.md5(w), at, 8), 16, 10).cast("long")
    return F.transform(words, lambda w: F.shiftleft(half(w, 1), 32).bitwiseOR(half(w, 9)))


def _pack(size: int, extra: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list[pa.RecordBatch]] = {False: [], True: []}
        number = TaskContext.get().partitionId() << 32

        def chunk(mark: bool, rows: pa.Table) -> pa.RecordBatch:
            nonlocal number
            words = rows.column(2).combine_chunks()
            words = pa.concat_arrays(words.chunks) if isinstance(words, pa.ChunkedArray) else words
            n = pa.compute.fill_null(pa.compute.list_value_length(words), 0).to_numpy()
            keys, row = words.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(n)), n)
            order = np.lexsort((keys, row))
            keys, row = keys[order], row[order]
            at = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])])) if len(keys) else np.zeros(0, np.int64)
            counts = np.diff(np.append(at, len(keys))).astype(np.int32)
            more = np.stack([rows.column(3 + i).to_numpy().astype(np.int64) for i in range(extra)]) if extra else np.zeros(0, np.int64)
            values = (rows.column(0).to_numpy().astype(np.int64), more, np.bincount(row[at], minlength=len(n)).astype(np.int32), keys[at], counts)
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([number - 1]), pa.array([mark]), *(pa.array([v.tobytes()], pa.binary()) for v in values)], names=[f.split()[0] for f in FIELDS.split(", ")])

        for batch in batches:
            marks = batch.column(1)
            for mark in (False, True):
                part = batch.filter(marks if mark else pa.compute.invert(marks))
                held[mark].append(part)
                rows = pa.Table.from_batches(held[mark])
                while len(rows) >= size:
                    yield chunk(mark, rows.slice(0, size))
                    rows = rows.slice(size)
                held[mark] = rows.to_batches()
        for mark in (False, True):
            if held[mark] and (rows := pa.Table.from_batches(held[mark])).num_rows:
                yield chunk(mark, rows)

    return run


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each chunk the distinct words and the number of its rows that hold them."""
    for batch in batches:
        for chunk, keys in zip(batch.column(0), batch.column(1), strict=True):
            terms, n = np.unique(np.frombuffer(keys.as_py(), np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(terms), chunk.as_py())), pa.array(terms), pa.array(n.astype(np.int64))], names=["chunk", "key", "n"])


def terms_of(packed: DataFrame) -> DataFrame:
    return packed.select("chunk", "keys").mapInArrow(_distinct, "chunk long, key long, n long")


def pack(rows: DataFrame, words: str, extra: Sequence[str] = (), mark: str | None = None, head: int | None = None) -> Packed:
    """Rows (id, an array of keys, columns of whole numbers) as chunks. mark: a boolean column; a chunk's rows agree in it."""
    n, head = rows.select("id").count(), HEAD if head is None else head
    parts = max(1, min(PIECES, -(-n // LEAST)), -(-n // PART))
    columns = [F.col("id").cast("long").alias("id"), (F.col(mark) if mark else F.lit(False)).alias("mark"), F.col(words), *(F.col(c).cast("long") for c in extra)]
    dealt = rows.where("id is not null").select(*columns).repartition(parts, "id")
    chunks = keep(rows.sparkSession, dealt.mapInArrow(_pack(CHUNK, len(extra)), FIELDS))
    top = terms_of(chunks).groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "key").limit(head).collect() if head else []
    return Packed(chunks, np.sort(np.array([r["key"] for r in top], np.int64)), parts)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk, terms in zip(batch.column(0), batch.column(1), strict=True):
            keys, n = (terms.values.field(c).to_numpy().astype(np.int64) for c in (0, 1))
            order = np.argsort(keys)
            yield pa.RecordBatch.from_arrays([pa.array([chunk.as_py()]), *(pa.array([c[order].tobytes()], pa.binary()) for c in (keys, n))], names=["chunk", "terms", "df"])


def with_frequencies(packed: Packed) -> Packed:
    """Each chunk with its distinct words and the rows of the whole table that hold them (see frequency_of)."""
    terms = terms_of(packed.chunks)
    known = terms.join(terms.groupBy("key").agg(F.sum("n").alias("df")), "key").groupBy("chunk").agg(F.collect_list(F.struct("key", "df")).alias("terms"))
    listed = known.mapInArrow(_listed, "chunk long, terms binary, df binary")
    dealt = packed.chunks.join(listed, "chunk").repartitionById(packed.parts, F.shiftright("chunk", 32).cast("int"))
    return packed._replace(chunks=keep(packed.chunks.sparkSession, dealt))


def frequency_of(row: Sequence, keys: np.ndarray) -> np.ndarray:
    """The frequencies of a chunk's words, from the columns that with_frequencies adds."""
    terms, df = (np.frombuffer(c, np.int64) for c in row[-2:])
    return df[np.searchsorted(terms, keys)]


class Chunk:
    """A chunk's rows: ids, further columns, sizes (distinct words), norms (sums of squared values), and its words as a dense head
    and a tail sorted by key."""

    def __init__(self, row: Sequence, head: np.ndarray, valued: Callable | None) -> None:
        self.number = row[0]
        self.ids = np.frombuffer(row[2], np.int64)
        n = len(self.ids)
        self.extra = np.frombuffer(row[3], np.int64).reshape(-1, n) if n else np.zeros((0, 0), np.int64)
        lengths, keys, counts = np.frombuffer(row[4], np.int32), np.frombuffer(row[5], np.int64), np.frombuffer(row[6], np.int32)
        of = np.repeat(np.arange(n), lengths)
        values = counts.astype(np.float64)
        if valued:
            of, keys, values = valued(row, of, keys, values)
        self.sizes = np.bincount(of, minlength=n)
        self.norms = np.bincount(of, values * values, minlength=n)
        self.kind = np.float64 if valued or self.norms.max(initial=0) >= WHOLE else np.float32
        at = np.minimum(np.searchsorted(head, keys), max(len(head) - 1, 0))
        often = head[at] == keys if len(head) else np.zeros(len(keys), bool)
        self.head = np.zeros((n, len(head)), self.kind)
        self.head[of[often], at[often]] = values[often]
        rare = np.flatnonzero(~often)
        rare = rare[np.argsort(keys[rare], kind="stable")]
        self.rows, self.values = of[rare], values[rare].astype(self.kind)
        self.keys, self.first, self.held = np.unique(keys[rare], return_index=True, return_counts=True)
        self._made: dict = {}

    def matrix(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        """Head and tail as they are ("x"), squared ("xx") or as ones ("1")."""
        if name not in self._made:
            of = {"x": lambda v: v, "xx": np.square, "1": lambda v: (v != 0).astype(v.dtype)}[name]
            self._made[name] = of(self.head), of(self.values)
        return self._made[name]


class Meeting:
    """Two chunks; product(p, q) gives for each two rows the sum over their shared words of the one's p times the other's q."""

    def __init__(self, a: Chunk, b: Chunk) -> None:
        self.a, self.b, self._met = a, b, None

    def _shared(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Where rarer words meet: their places in both tails, and in the matrix as one row of numbers; in slices of about MET."""
        if self._met is None:
            a, b = self.a, self.b
            _, i, j = np.intersect1d(a.keys, b.keys, assume_unique=True, return_indices=True)
            na, nb = a.held[i], b.held[j]
            slices = np.cumsum(na * nb) // MET
            self._met = []
            for part in np.split(np.arange(len(i)), np.flatnonzero(np.diff(slices)) + 1) if len(i) else []:
                la, lb = na[part], nb[part]
                x = np.arange(la.sum()) - np.repeat(np.cumsum(la) - la - a.first[i[part]], la)  # each entry of a ...
                times = np.repeat(lb, la)
                y = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times - np.repeat(b.first[j[part]], la), times)  # ... meets all of b's
                x = np.repeat(x, times)
                self._met.append((x, y, a.rows[x] * len(b.ids) + b.rows[y]))
        return self._met

    def product(self, p: str, q: str) -> np.ndarray:
        (ha, ta), (hb, tb) = self.a.matrix(p), self.b.matrix(q)
        out = ha @ hb.T
        flat = out.reshape(-1)
        for x, y, at in self._shared():
            np.add.at(flat, at, (ta[x] * tb[y]).astype(out.dtype))
        return out


#: Of a meeting the places of the pairs to keep (rows of a, rows of b) and columns of values for them.
Rule = Callable[[Meeting], "tuple[np.ndarray, np.ndarray, list[np.ndarray]]"]


def _meet(rule: Rule, head: np.ndarray, names: Sequence[str], width: int, valued: Callable | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: OrderedDict[int, Chunk] = OrderedDict()

        def chunk(row: list) -> Chunk:
            if row[0].as_py() not in seen:
                seen[row[0].as_py()] = Chunk([c.as_py() for c in row], head, valued)
                if len(seen) > 12:
                    seen.popitem(last=False)
            seen.move_to_end(row[0].as_py())
            return seen[row[0].as_py()]

        for batch in batches:
            for r in range(batch.num_rows):
                row = [c[r] for c in batch.columns]
                a, b = chunk(row[:width]), chunk(row[width:])
                i, j, values = rule(Meeting(a, b))
                ids = a.ids[i], b.ids[j]
                ok = ids[0] < ids[1] if a is b else ids[0] != ids[1]
                ids = ids[0][ok], ids[1][ok]
                cols = [np.minimum(*ids), np.maximum(*ids), *(v[ok] for v in values)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["a", "b", *names])

    return run


def pairs(packed: Packed, rule: Rule, columns: str = "", marked: bool = False, valued: Callable | None = None) -> DataFrame:
    """The pairs (a, b, and the columns) that the rule keeps. It sees two rows in either order, so its values must not depend on
    that. marked: only chunks of which one has the mark meet. valued: gives other words and values from (a chunk's row, rows,
    keys, counts)."""
    names = packed.chunks.columns
    left, right = (packed.chunks.select(*(F.col(c).alias(f"{k}_{c}") for c in names)) for k in "ab")
    x, y = F.col("a_chunk"), F.col("b_chunk")
    once = (x == y) | ((F.pmod(F.xxhash64(F.least(x, y), F.greatest(x, y)), F.lit(2)) == 0) == (x < y))  # half of them either way round
    met = left.hint("shuffle_replicate_nl").join(right, once & (F.col("a_mark") | F.col("b_mark")) if marked else once)
    kinds = [c.strip() for c in columns.split(",")] if columns else []
    return met.mapInArrow(_meet(rule, packed.head, [k.split()[0] for k in kinds], len(names), valued), ", ".join(["a long", "b long", *kinds]))
