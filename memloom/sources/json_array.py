"""Files that hold one JSON array of objects, of any size: read by byte ranges in many tasks, and written.

A file is cut at closing braces, which Spark's text reader finds from any byte range on. Whether a range begins inside a string,
and how deep, follows from the quotes and brackets of all ranges before it, which are summed up first. A second pass gives
the records that lie within a range; of those that cross into others only the fragments are shuffled and put together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_ESCAPED = re.compile(r"\\.", re.S)
_RUN = ["_file", "_block"]


def _depths(piece: str) -> tuple[int, int, int]:
    """Quotes of a piece, and what its brackets add to the depth if it begins outside, or inside, a string."""
    parts = _ESCAPED.sub("", piece).split('"')
    depth = lambda some: sum(p.count("{") + p.count("[") - p.count("}") - p.count("]") for p in some)
    return len(parts) - 1, depth(parts[::2]), depth(parts[1::2])


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The file's text up to each closing brace, in order within a range (_file, _block)."""
    return spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), "value")


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[str, int], list[int]] = {}
    for batch in batches:
        for file, block, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            quotes, outside, inside = _depths(piece)
            got = sums.setdefault((file, block), [0, 0, 0])
            if got[0] % 2:
                outside, inside = inside, outside
            got[0] += quotes
            # each piece but the file's last ends in a brace, which counts where it lies outside strings
            got[1] += outside - (got[0] % 2 == 0)
            got[2] += inside - (got[0] % 2 == 1)
    rows = [(*k, *v) for k, v in sums.items()]
    if rows:
        f, b, q, o, i = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(b, pa.int64()), *(pa.array(x, pa.int64()) for x in (q, o, i))], names=[*_RUN, "quotes", "outside", "inside"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file, range, text, in a string at the range's begin, depth there) -> records (kind "whole") and fragments: "head" or
    "middle" of a record that began in a range before, "tail" of one that goes on behind."""
    run, held, inside, depth, began = None, [], 0, 0, False
    for batch in batches:
        out: list[tuple] = []
        for file, block, piece, start_inside, start_depth in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (file, block) != run:
                if held:
                    out.append((*run, "tail" if began else "middle", "".join(held)))
                run, held, inside, depth, began = (file, block), [], start_inside, start_depth, False
            quotes, outside, within = _depths(piece)
            change = within if inside else outside
            if depth <= 1:
                at = piece.find("{")
                if at >= 0:
                    held, began = [piece[at:], "}"], True
            else:
                held += [piece, "}"]
            inside = (inside + quotes) % 2
            depth += change - (inside == 0)
            if depth == 1 and not inside and held:
                out.append((*run, "whole" if began else "head", "".join(held)))
                held, began = [], False
        if out:
            yield _rows(out)
    if held:
        yield _rows([(*run, "tail" if began else "middle", "".join(held))])


def _rows(out: list[tuple]) -> pa.RecordBatch:
    f, b, k, t = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(f), pa.array(b, pa.int64()), pa.array(k), pa.array(t)], names=[*_RUN, "kind", "text"])


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """The texts of the objects of the JSON arrays in files below `path`: a column text. Order isn't kept. Arrays hold objects
    alone; an empty array has no rows. A task holds one object at a time; what is shuffled are the ranges' sums and the
    fragments of objects that cross ranges."""
    pieces = _pieces(spark, path)
    sums = pieces.mapInArrow(_measure, "_file string, _block long, quotes long, outside long, inside long").groupBy(*_RUN).agg(*(F.sum(c).alias(c) for c in ("quotes", "outside", "inside")))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_in", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2).cast("int"))
    starts = starts.withColumn("_change", F.when(F.col("_in") == 1, F.col("inside")).otherwise(F.col("outside"))).withColumn("_deep", F.coalesce(F.sum("_change").over(before), F.lit(0)))
    told = pieces.join(F.broadcast(starts.select(*_RUN, "_in", "_deep")), _RUN)  # a row for each range of some megabytes
    cut = told.select(*_RUN, "value", "_in", "_deep").mapInArrow(_cut, "_file string, _block long, kind string, text string")
    parts = cut.where("kind <> 'whole'")
    whose = F.sum((F.col("kind") == "tail").cast("int")).over(Window.partitionBy("_file").orderBy("_block", F.when(F.col("kind") == "tail", 1).otherwise(0)))
    joined = parts.withColumn("_of", whose).where("_of > 0").groupBy("_file", "_of").agg(F.array_sort(F.collect_list(F.struct("_block", (F.col("kind") == "tail").cast("int").alias("_last"), "text"))).alias("_parts"))
    return cut.where("kind = 'whole'").select("text").unionByName(joined.select(F.array_join(F.transform("_parts", lambda p: p["text"]), "").alias("text")))


def read_json_array(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The objects as rows; one that doesn't fit the schema has nulls."""
    return json_records(spark, path).select(F.from_json("text", schema).alias("_r")).select("_r.*")


def write_json_array(rows: DataFrame, path: str) -> None:
    """Rows as files of one JSON array each, one file for each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            lines = [("[" if first and i == 0 else ",") + t for i, t in enumerate(batch.column(0).to_pylist())]
            if lines:
                first = False
                yield pa.RecordBatch.from_arrays([pa.array(lines)], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if first else "]"])], names=["value"])

    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).mapInArrow(run, "value string").write.text(path)
