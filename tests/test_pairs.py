"""Candidates of the set join hold every like pair, for equal sets and hot words too."""

import numpy as np
import pytest

from memloom.operators import pairs


@pytest.mark.parametrize("threshold, hot", [(0.2, 20_000), (0.2, 7), (0.5, 7), (0.8, 3)])
def test_set_join_loses_no_pair(spark, monkeypatch, threshold, hot):
    monkeypatch.setattr(pairs, "HOT", hot)
    rng = np.random.default_rng(3)
    base = [[f"w{x}" for x in rng.zipf(1.5, int(rng.integers(1, 30))) % 200] for _ in range(40)]
    sets = []
    for i in range(160):
        own = list(base[int(rng.integers(40))])
        own += [f"n{x}" for x in rng.integers(0, 300, int(rng.integers(0, 12)))] if i % 3 else []
        sets.append((i, sorted(set(own))))
    sets += [(500, []), (501, []), (502, ["only"]), (503, ["only"])]
    got = pairs.overlapping_pairs(spark.createDataFrame(sets, "id long, w array<string>"), threshold).collect()
    found = {(r["a"], r["b"]) for r in got}
    assert len(found) == len(got) and all(a < b for a, b in found)
    like = {(a, b) for a, x in sets for b, y in sets if a < b and x and len({*x} & {*y}) >= threshold * len({*x} | {*y}) - 1e-9}
    assert like <= found and len(like) > 30 and (502, 503) in found


def test_opposites_within_a_topic(spark):
    rows = [(1, "a", ["happy", "x"]), (2, "a", ["sad"]), (3, "b", ["sad", "unhappy"]), (4, "b", ["y"])]
    df = spark.createDataFrame(rows, "id long, topic string, w array<string>")
    words = [("happy", "sad"), ("happy", "unhappy")]
    key = lambda x: {(r["a"], r["b"]) for r in x.collect()}
    assert key(pairs.opposite_pairs(df, words)) == {(1, 2), (1, 3)} and key(pairs.opposite_pairs(df, words, ("topic",))) == {(1, 2)}
    assert {r["id"] for r in pairs.holders(df, words).collect()} == {1, 2, 3}
