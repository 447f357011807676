"""Nearest vectors against numpy: exact scans, exact cells, recall of a few cells, upkeep."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from memloom.operators.nearest import CellIndex, cosine_top
from memloom.plans.indexes import cell_index
from memloom.plans.views import table


def made(spark, n=600, d=12, seed=0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(20, d))
    v = centers[rng.integers(20, size=n)] + rng.normal(size=(n, d)) * 0.4
    rows = [(i, [float(x) for x in v[i]]) for i in range(n)] + [(n, [0.0] * d), (n + 1, None), (n + 2, [1.0] * (d + 1)), (n + 3, [float("nan")] * d)] + [(n + 4 + i, [float(x) for x in v[0]]) for i in range(15)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def unit(x, d=12):
    x = np.array(x if x is not None and len(x) == d and np.isfinite(x).all() else [0.0] * d)
    return x / (np.linalg.norm(x) or 1)


def plain(rows, asked, k):
    m = np.array([unit(v) for _, v in rows])
    ids = np.array([i for i, _ in rows])
    out = set()
    for q in asked:
        s = np.round(m @ unit(dict(rows)[q]), 9)
        out |= {(q, p + 1, int(ids[i])) for p, i in enumerate(np.lexsort((ids, -s))[:k])}
    return out


def key(df):
    return {(r["query"], r["place"], r["vec_id"]) for r in df.collect()}


def test_exact_scan_and_cells(spark, tmp_path):
    rows, df = made(spark)
    asked = [0, 5, 17, 333, 600, 601]
    queries = df.where(F.col("vec_id").isin(asked))
    want = plain(rows, asked, 10)
    assert key(cosine_top(df, queries, 10)) == want
    index = CellIndex(spark, f"file://{tmp_path}/c")
    index.build(df)
    assert key(index.search(queries, 10)) == want
    meta = index.versions.entry()["meta"]
    near = key(index.search(queries.where("vec_id < 600"), 10, meta["probes"]))
    sets = lambda x: {(q, v) for q, _, v in x if q < 600}
    assert len(sets(near) & sets(want)) >= 0.8 * len(sets(want)) and meta["probes"] < meta["cells"]
    new = [(5, rows[17][1]), (9000, rows[333][1])]
    index.add(spark.createDataFrame(new, "vec_id long, embedding array<double>"))
    index.delete(df.where("vec_id = 333").select("vec_id"))
    now = [(i, v) for i, v in rows if i not in (5, 333)] + new
    assert key(index.search(queries.where("vec_id in (0, 17)"), 10)) == plain(now, [0, 17], 10)
    plan = index.search(queries.where("vec_id = 0"), 10, 1)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*group", plan)
    assert cosine_top(df, queries.limit(0), 10).count() == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_recall_of_the_tuned_index(spark, sf):
    """Each hundredth vector against all rows: at least nine of ten of the exact neighbours."""
    v = table(spark, sf, "embeddings")
    queries = v.where("vec_id % 100 = 0")
    index = cell_index(spark, sf)
    exact = {(r["query"], r["vec_id"]) for r in cosine_top(v, queries, 10).collect()}
    got = {(r["query"], r["vec_id"]) for r in index.search(queries, 10, index.versions.entry()["meta"]["probes"]).collect()}
    assert len(exact & got) >= 0.9 * len(exact) and len(exact) == 10 * queries.count()
