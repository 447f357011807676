"""Time phrases of a table of queries equal those of single strings."""

from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from memloom.functions.temporal import MONTHS, in_time_range, parse, time_range


def test_columns_equal_the_parser(spark):
    rng = np.random.default_rng(2)
    n = lambda: str(rng.integers(0, 400))
    kinds = [
        lambda: "Yesterday", lambda: "today?", lambda: f"{n()} hours ago", lambda: f"{n()} day  ago", lambda: f"{n()} weeks ago", lambda: f"the past {n()} days", lambda: "last WEEK", lambda: "this week",
        lambda: "last month", lambda: "this month", lambda: "last year", lambda: f"in {MONTHS[rng.integers(12)].title()}", lambda: f"{MONTHS[rng.integers(12)]} {rng.integers(1990, 2035)}", lambda: f"since {rng.integers(1900, 2100)}",
        lambda: "dismay and 1850", lambda: "nothing", lambda: "",
    ]
    rows = []
    for i in range(400):
        words = " and ".join(kinds[int(rng.integers(len(kinds)))]() for _ in range(int(rng.integers(1, 3))))
        rows.append((i, words, datetime(2000, 1, 1) + timedelta(seconds=int(rng.integers(0, 30 * 365 * 86400)))))
    rows += [(900 + k, "last month", datetime(2024, m, d, 5)) for k, (m, d) in enumerate([(1, 1), (1, 31), (3, 31), (12, 31), (2, 29)])]
    df = spark.createDataFrame([*rows, (999, None, datetime(2024, 1, 1))], "id long, q string, at timestamp_ntz")
    begin, end = time_range(F.col("q"), F.col("at"))
    got = {r["id"]: (r["a"], r["b"]) for r in df.select("id", begin.alias("a"), end.alias("b")).collect()}
    for i, q, at in rows:
        assert got[i] == (parse(q, at) or (None, None)), (q, at)
    assert got[999] == (None, None)
    assert sum(a is not None for a, _ in got.values()) > 300
    inside = df.where("id >= 900").select("id", in_time_range(F.lit("2024-02-10 00:00:00").cast("timestamp_ntz"), F.col("q"), F.col("at")).alias("x")).collect()
    assert {r["id"] for r in inside if r["x"]} == {902}
    assert spark.range(1).select(time_range(F.lit("99999999999 days ago"), F.lit("2024-01-01").cast("timestamp_ntz"))[0].alias("x")).first()["x"] is None
