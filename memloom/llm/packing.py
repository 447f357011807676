"""Best-fit packing of token pieces into sequences by the sum-of-squares rule."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm import textvec
from memloom.llm.common import keep, table
from memloom.llm.wordbpe import WordTokenizer

SEQUENCE, END_ID = 2048, 0
#: Pieces that one task packs together; more pieces make more groups.
GROUP = 50_000

_tokenizers: dict[str, WordTokenizer] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenize_pieces(docs: DataFrame, tokenizer: str | None = None, size: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Cut each text's ids, closed by END_ID, into pieces of at most `size`: id, piece, start, length, ids_crc32 (of the
    little-endian unsigned 32-bit ids) and, on demand, ids. Only texts longer than `size` are cut."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _tokenizers:
            _tokenizers[path] = WordTokenizer(path)
        tok = _tokenizers[path]
        for batch in batches:
            buf, offsets = textvec.raw(batch.column(1))
            for i, j in textvec.slices(buf, offsets):
                ids, begin = tok.encode(buf[offsets[i] : offsets[j]], offsets[i : j + 1], END_ID)
                ids = ids.astype("<u4")
                n = np.diff(begin)
                pieces = -(-n // size)
                doc = np.repeat(np.arange(j - i), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * size
                length = np.minimum(size, n[doc] - start)
                at = begin[doc] + start
                crc = [zlib.crc32(ids[a : a + m]) for a, m in zip(at.tolist(), length.tolist(), strict=True)]
                cols = [batch.column(0).slice(i, j - i).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.array([ids[a : a + m].astype(np.int32) for a, m in zip(at.tolist(), length.tolist(), strict=True)], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length, in the given order, and the number of bins.

    counts[g] is the number of open bins with a gap of g. Each item goes where the sum of the squared counts becomes
    smallest: into a bin of some gap, or into a new bin. Ties go to the smallest gap.
    """
    counts = np.zeros(size + 1, np.int64)
    stacks: dict[int, list[int]] = {}
    bins, offsets, opened = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    never = np.int64(1) << 60
    for i, s in enumerate(lengths.tolist()):
        tail = counts[s:]
        change = np.where(tail > 0, -2 * tail + 1, never)
        change[-1] = 0  # a new bin
        change[1:] += 2 * counts[1 : size - s + 1] + 1
        gap = s + int(change.argmin())
        if gap == size:
            b = opened
            opened += 1
        else:
            b = stacks[gap].pop()
            counts[gap] -= 1
        bins[i], offsets[i] = b, size - gap
        if gap > s:
            counts[gap - s] += 1
            stacks.setdefault(gap - s, []).append(b)
    return bins, offsets, opened


def pack(spark: SparkSession, pieces: DataFrame, size: int = SEQUENCE, id_col: str = "doc_id") -> DataFrame:
    """Adds sequence_id and offset to pieces (id, piece, length and more). Pieces are written once and dealt into groups by a
    hash of id, piece and their place in what was written, so no task sees more than about GROUP of them even if all rows
    repeat one id and piece; each group is packed from the longest to the shortest.

    Repeated ids and pieces are packed one by one, in a fixed order; null ids are packed like others. Lengths lie between 1
    and `size`. An empty table gives an empty table. Extra columns pass through.
    """
    pieces = keep(spark, pieces)
    rows = pieces.count()
    groups = max(1, -(-rows // GROUP))
    schema = pieces.schema.simpleString()[len("struct<") : -1]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "_memloom_order", "ids_crc32"] if "ids_crc32" in pdf else ["length", "_memloom_order"], ascending=False, kind="stable")
        bins, offsets, _ = sum_of_squares(pdf["length"].to_numpy(np.int64), size)
        return pdf.assign(sequence_id=bins + (pdf["_memloom_group"].to_numpy(np.int64) << 32), offset=offsets).drop(columns=["_memloom_group", "_memloom_order"])

    order = F.xxhash64(id_col, "piece")
    dealt = pieces.withColumn("_memloom_order", order).withColumn("_memloom_group", F.pmod(F.xxhash64(id_col, "piece", F.monotonically_increasing_id()), F.lit(groups)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return dealt.groupBy("_memloom_group").applyInPandas(run, f"{fields}, sequence_id long, offset long") if schema else pieces


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None, size: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise and pack: a row for each piece with its place. Null or empty text: one piece that holds END_ID alone.
    Repeated rows are packed as often as they occur; null ids are allowed; extra columns are not read."""
    return pack(spark, tokenize_pieces(docs, tokenizer, size, id_col, text_col), size, id_col)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark, table(spark, sf_dir, "documents"))
