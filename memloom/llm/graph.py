"""Connected components over tables of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm.common import forget, keep


#: Links that one task contracts at once. A node that more links lead to than a task's share / OFTEN is known to all tasks.
CONTRACTED, OFTEN = 500_000, 64


def _width(links: int) -> int:
    return max(4, links // CONTRACTED + 1)


def _contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links: each node that reaches a lesser one, and the least that it reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        least = np.minimum(label[x], label[y])
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
        np.minimum.at(label, before, label)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(before, label):
            break
    more = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[more], nodes[label[more]]


def _columns(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
    parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one partition's links: a link from each node to the least node that it reaches within the partition."""
    if columns := _columns(batches):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _contracted(*columns)], names=["a", "b"])


def _hops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Like _forest, of rows (a, b, above). A link that is here only with its lesser end and stays as it was is left out: the
    partition of its greater end has all of that node's lesser neighbours and sends it on."""
    if columns := _columns(batches):
        a, b, above = columns
        x, y = _contracted(a, b)
        pairs = np.stack([np.concatenate([x, a]), np.concatenate([y, b])], 1)
        _, which = np.unique(pairs, axis=0, return_inverse=True)
        which = which.ravel()
        seen = np.zeros((2, len(which)), bool)
        seen[above.astype(int), which[len(x) :]] = True
        new = ~seen[1, which[: len(x)]] | seen[0, which[: len(x)]]
        yield pa.RecordBatch.from_arrays([pa.array(x[new]), pa.array(y[new])], names=["a", "b"])


def _ends(links: DataFrame, once: str | None = None) -> DataFrame:
    """Each link (a, b), a > b, with its greater end and, unless a column says once, with its lesser one."""
    greater, lesser = (F.struct(F.col(c).alias("node"), F.lit(c == "b").alias("above")) for c in "ab")
    ends = F.array(greater, lesser)
    if once:
        ends = F.when(F.col(once), F.array(greater)).otherwise(ends)
    return links.select("a", "b", F.explode(ends).alias("_e")).select("a", "b", "_e.node", "_e.above")


def _unfinished(links: DataFrame, often: int) -> tuple[int, list[tuple[int, int | None]]]:
    """How many nodes have two lesser neighbours, or a lesser and a greater one: with none, all links are stars. And the nodes
    that more than so many links lead to, with their least neighbours below them, if any."""
    nodes = _ends(links).groupBy("node").agg(F.min(F.expr("if(above, null, b)")).alias("low"), F.max(F.expr("if(above, null, b)")).alias("high"), F.count_if("above").alias("n"))
    row = nodes.agg(F.count_if(F.expr("low < high or low is not null and n > 0")).alias("open"), F.collect_list(F.when(F.col("n") > often, F.struct("node", "low"))).alias("hot")).first()
    return row["open"], [(r["node"], r["low"]) for r in row["hot"]]


def _hop(spark: SparkSession, links: DataFrame, width: int, hot: list[tuple[int, int | None]]) -> DataFrame:
    """Each node meets its neighbours in one partition, which links them to the least node that they reach there. What links
    to a node of many is linked to that node's least neighbour without meeting it."""
    ends = _ends(links)
    if hot:
        known = F.broadcast(spark.createDataFrame(hot, "_of long, _low long"))
        met = links.join(known, links["b"] == known["_of"], "left").select("a", F.coalesce("_low", "b").alias("b"), F.col("_of").isNotNull().alias("_hot"))
        ends = _ends(met, "_hot")
    return keep(spark, ends.repartition(width, "node").select("a", "b", "above").mapInArrow(_hops, "a long, b long"))


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """Links (a, b), longs, in any direction and number, to (node, component): the least node that each can reach. Nodes
    without a link to another don't occur.

    Links that are more than one task contracts are first dealt by both ends, so that a node of many links is spread, and each
    partition contracts its own to a forest: what is left grows with the nodes and not with the links. Then links are dealt by
    node, once for each end, and contracted again until all are stars: the rounds grow with the logarithm of the longest path,
    and each is one shuffle. No node's links are gathered into one row. Each round is written to the shared folder.
    """
    now = keep(spark, links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b"))
    n = now.count()
    if n > CONTRACTED:
        now, before = keep(spark, now.repartition(_width(n), "a", "b").mapInArrow(_forest, "a long, b long")), now
        forget(spark, before)
        n = now.count()
    while n:
        open_, hot = _unfinished(now, n // (OFTEN * _width(n)))
        if not open_:
            break
        now, before = _hop(spark, now, _width(n), hot), now
        forget(spark, before)
        n = now.count()
    ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("component")), F.struct(F.col("b").alias("node"), F.col("b").alias("component"))))
    return now.select(ends.alias("_e")).select("_e.*").distinct()
