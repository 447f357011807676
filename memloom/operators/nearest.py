"""Nearest vectors by cosine: all rows by blocks of matrix products, or the cells of an inverted-file index.

Exact search is one scan for each block of queries. The index puts each vector into the cell of its nearest center, the centers
being trained on a bounded sample; a search visits the cells of the nearest centers, either a fixed number of them or, with
the cells' radii as bounds, all that can hold one of the k best.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memloom.sources.versions import Versions

#: Queries that one scan answers, and rows that meet them at once.
QUERY_BLOCK, ROWS = 1_024, 2_048
#: Vectors for each center that the training sees, its rounds, the most bytes of its sample, and the most cells.
PER_CELL, TRAINING_ROUNDS, SAMPLE_BYTES, MOST_CELLS = 64, 12, 64 << 20, 16_384
#: Cells that share a folder.
CELL_GROUP = 16
#: Queries on which the number of visited cells is chosen.
TUNED_ON = 64


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows scaled to length 1; null vectors, zero vectors and those of another length or with null or non-finite parts are 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten()
    sizes = np.diff(np.asarray(column.offsets)) if len(column) else np.zeros(0, int)
    sizes = np.where(np.asarray(column.is_valid()), sizes, 0)
    out = np.zeros((len(column), d))
    fits = sizes == d
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    out[fits] = values[starts[fits][:, None] + np.arange(d)]
    out[~np.isfinite(out).all(axis=1)] = 0
    most = np.abs(out).max(axis=1, keepdims=True) if len(out) else out[:, :1]
    out /= np.where(most > 0, most, 1)
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norms > 0, norms, 1)


class _Best:
    """The k best rows of each query so far; equal scores (to 9 places) by rising id."""

    def __init__(self, k: int) -> None:
        self.k, self.held = k, []

    def add(self, queries: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """scores: a row for each query, a column for each id."""
        rounded = np.round(scores, 9)
        if scores.shape[1] > self.k:
            least = np.partition(rounded, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k]
            q, c = np.nonzero(rounded >= least[:, None])
        else:
            q, c = (x.ravel() for x in np.indices(scores.shape))
        self.held.append((queries[q], ids[c], scores[q, c]))
        if sum(len(x[0]) for x in self.held) > 1 << 18:
            self.held = [self.best()]

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, ids, s = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((ids, -np.round(s, 9), q))
        q, ids, s = q[order], ids[order], s[order]
        first = np.searchsorted(q, q)
        kept = np.arange(len(q)) - first < self.k
        return q[kept], ids[kept], s[kept]


def _placed(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "vec_id")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("query", "place", "vec_id", "score")


def _scan(rows: DataFrame, asked: tuple[list, np.ndarray], k: int, visits: dict[int, np.ndarray] | None = None) -> DataFrame:
    """The k best of each task for the asked queries (ids, unit rows). rows: vec_id, embedding and, with visits, cell: then a
    query meets only the cells that it visits."""
    names, matrix = asked
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, every = _Best(k), np.arange(len(names))
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                ids, unit = part.column(0).to_numpy(zero_copy_only=False), _matrix(part.column(1), matrix.shape[1])
                if visits is None:
                    best.add(every, ids, matrix @ unit.T)
                    continue
                cells = part.column(2).to_numpy()
                for c in np.unique(cells).tolist():
                    if len(mine := visits.get(c, ())):
                        here = np.flatnonzero(cells == c)
                        best.add(mine, ids[here], matrix[mine] @ unit[here].T)
        if best.held:
            q, ids, s = best.best()
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in q.tolist()], type=None), pa.array(ids), pa.array(s)], names=["query", "vec_id", "score"])

    return rows.mapInArrow(run, f"query {kinds['vec_id']}, vec_id {kinds['vec_id']}, score double")


def _blocks(queries: DataFrame, d: int) -> Iterator[tuple[list, np.ndarray]]:
    """The queries on the driver, QUERY_BLOCK or so at a time."""
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    for b in range(blocks):
        got = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).select("vec_id", "embedding").toArrow()
        if len(got):
            yield got.column(0).to_pylist(), _matrix(got.column(1), d)


def _length(vectors: DataFrame) -> int:
    got = vectors.where("embedding is not null").select(F.size("embedding").alias("d")).first()
    return got["d"] if got else 0


def _none(vectors: DataFrame) -> DataFrame:
    kind = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}["vec_id"]
    return vectors.sparkSession.createDataFrame([], f"query {kind}, place int, vec_id {kind}, score double")


def cosine_top(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """For each query the k rows (vec_id, embedding) of greatest cosine, exactly: query, place, vec_id, score. Each block of
    queries meets all rows where these lie, and a task gives k rows for a query at most. Vectors without a direction score 0."""
    found = [_scan(vectors.select("vec_id", "embedding"), asked, k) for asked in _blocks(queries, _length(vectors))]
    return _placed(reduce(DataFrame.unionByName, found), k) if found else _none(vectors)


def train(sample: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Centers of length 1 by spherical k-means."""
    rng = np.random.default_rng(seed)
    centers = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(TRAINING_ROUNDS):
        own = np.concatenate([(sample[i : i + ROWS] @ centers.T).argmax(1) for i in range(0, len(sample), ROWS)])
        sums = np.zeros_like(centers)
        np.add.at(sums, own, sample)
        empty = np.linalg.norm(sums, axis=1) < 1e-12
        sums[empty] = sample[rng.choice(len(sample), int(empty.sum()))]
        centers = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return centers


class CellIndex:
    """An inverted-file index below a folder: every vector in the cell of its nearest center."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.versions = spark, Versions(spark, path)

    @property
    def built(self) -> bool:
        return self.versions.latest() > 0

    def build(self, vectors: DataFrame, cells: int | None = None, recall: float = 0.9, k: int = 10) -> int:
        """Index all vectors (vec_id, embedding). Centers are trained on a sample by id of about PER_CELL vectors a cell and
        SAMPLE_BYTES at most; cells are about the square root of the rows. The number of cells that a search visits is the
        least that finds the share `recall` of the k nearest of TUNED_ON sampled vectors."""
        rows, d = vectors.count(), _length(vectors)
        cells = cells or int(min(MOST_CELLS, max(1, rows**0.5)))
        wanted = min(rows, PER_CELL * cells, SAMPLE_BYTES // (8 * max(d, 1)))
        share = F.pmod(F.xxhash64("vec_id", F.lit("train")), F.lit(1 << 20)) <= min(1.0, 1.1 * wanted / max(rows, 1)) * (1 << 20)
        sample = _matrix(vectors.where(share & F.col("embedding").isNotNull()).select("embedding").toArrow().column(0), d) if rows else np.zeros((0, d))
        sample = sample[np.abs(sample).sum(1) > 0]
        centers = train(sample, cells) if len(sample) else np.zeros((1, max(d, 1)))
        part = self._write(vectors, centers)
        meta = {"cells": len(centers), "length": d, "probes": len(centers)}
        version = self.versions.commit([part, self._cells(part[1], centers)], replace=True, note="build", meta=meta)
        asked = vectors.where(F.pmod(F.xxhash64("vec_id", F.lit("tune")), F.lit(max(1, rows // TUNED_ON))) == 0).limit(TUNED_ON)
        return self._tune(asked, k, recall) if rows else version

    def _write(self, vectors: DataFrame, centers: np.ndarray) -> tuple[str, str]:
        d = centers.shape[1]

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, len(batch), ROWS):
                    part = batch.slice(at, ROWS)
                    near = _matrix(part.column(1), d) @ centers.T
                    cell = near.argmax(1)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(near[np.arange(len(cell)), cell])], names=["vec_id", "embedding", "cell", "near"])

        kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
        rows = vectors.select("vec_id", "embedding").mapInArrow(assign, f"vec_id {kinds['vec_id']}, embedding {kinds['embedding']}, cell int, near double")
        rows = rows.withColumn("group", F.floor(F.col("cell") / CELL_GROUP).cast("int"))
        return self.versions.write("vectors", rows.repartitionByRange("group", "cell", "vec_id").sortWithinPartitions("group", "cell"), ("group",))

    def _cells(self, folder: str, centers: np.ndarray) -> tuple[str, str]:
        """The centers, and the least cosine of a cell's vectors to its center."""
        least = self.spark.read.parquet(f"{self.versions.path}/{folder}").groupBy("cell").agg(F.min("near").alias("least"), F.count("*").alias("n"))
        known = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "cell int, center array<double>")
        return self.versions.write("cells", known.join(least, "cell", "left"))

    def _tune(self, asked: DataFrame, k: int, recall: float) -> int:
        exact = {}
        for r in self.search(asked, k).collect():  # TUNED_ON * k rows
            exact.setdefault(r["query"], set()).add(r["vec_id"])
        probes, most = 1, self.versions.entry()["meta"]["cells"]
        while probes < most:
            got = {}
            for r in self.search(asked, k, probes).collect():
                got.setdefault(r["query"], set()).add(r["vec_id"])
            if sum(len(x & got.get(q, set())) for q, x in exact.items()) >= (recall + (1 - recall) / 3) * sum(map(len, exact.values())):
                break
            probes = min(most, 2 * probes)
        return self.versions.commit([], note="tune", meta={"probes": probes})

    def add(self, vectors: DataFrame) -> int:
        """New or replaced vectors go to the cells of the centers there are; cells whose radius grows are told so."""
        meta = self.versions.entry()["meta"]
        centers = np.zeros((meta["cells"], meta["length"]))
        for r in self.versions.read("cells").select("cell", "center").collect():
            centers[r["cell"]] = r["center"]
        part = self._write(vectors, centers)
        return self.versions.commit([part, self._cells(part[1], centers), self.versions.write("gone", vectors.select(F.col("vec_id")))], note="add")

    def delete(self, ids: DataFrame) -> int:
        return self.versions.commit([self.versions.write("gone", ids.select("vec_id"))], note="delete")

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """For each query the k nearest vectors. With probes, of the cells of that many nearest centers. Without, exactly: the
        first cells give a k-th best score, and only cells are visited in which a vector can still reach it."""
        meta, version = self.versions.entry()["meta"], self.versions.latest()
        cells = self.versions.read("cells", version).groupBy("cell").agg(F.first("center").alias("center"), F.min("least").alias("least")).where("least is not null").toArrow()  # MOST_CELLS at most
        number, centers = cells.column(0).to_numpy(), _matrix(cells.column(1), meta["length"])
        radius = np.arccos(np.clip(cells.column(2).to_numpy(), -1, 1))
        rows, found = self.versions.live("vectors", version, "vec_id"), []
        for names, matrix in _blocks(queries, meta["length"]):
            away = np.arccos(np.clip(matrix @ centers.T, -1, 1))
            first = np.zeros(away.shape, bool)
            np.put_along_axis(first, np.argsort(away, axis=1)[:, : probes or 4], True, axis=1)
            got = self._visit(rows, names, matrix, number, first, k)
            found.append(got)
            if probes is None:
                kth = {r["query"]: r["s"] for r in got.groupBy("query").agg(F.sort_array(F.collect_list("score"), False).alias("s")).select("query", F.get("s", F.lit(k - 1)).alias("s")).collect()}
                least = np.array([-2.0 if kth.get(q) is None else kth[q] for q in names])
                reach = np.cos(np.maximum(0, away - radius[None, :]))
                zero = ~(np.abs(matrix).sum(1) > 0)
                more = ((reach >= least[:, None] - 1e-7) | zero[:, None]) & ~first
                if more.any():
                    found.append(self._visit(rows, names, matrix, number, more, k))
        return _placed(reduce(DataFrame.unionByName, found), k) if found else _none(rows)

    def _visit(self, rows: DataFrame, names: list, matrix: np.ndarray, number: np.ndarray, chosen: np.ndarray, k: int) -> DataFrame:
        visits = {int(number[c]): np.flatnonzero(chosen[:, c]) for c in np.flatnonzero(chosen.any(axis=0))}
        wanted = rows.where(F.col("group").isin(sorted({c // CELL_GROUP for c in visits})) & F.col("cell").isin(sorted(visits)))
        return _scan(wanted.select("vec_id", "embedding", "cell"), (names, matrix), k, visits)
