"""Extraction, rules, vectors, merges and chains against values worked out by hand and brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from memloom.functions import rules
from memloom.operators import conversations, extraction, graph, pairs, search, vectors


def test_chains_of_a_long_path(spark):
    links = [(i, i + 1) for i in range(1000)] + [(5000, 5001)]
    got = {r["node"]: r["chain"] for r in graph.chains(spark, spark.createDataFrame(links, "source long, target long")).collect()}
    assert got == {**dict.fromkeys(range(1001), 0), 5000: 5000, 5001: 5000}
    assert graph.chains(spark, spark.createDataFrame([], "source long, target long")).count() == 0


def test_extracted_facts(spark):
    texts = [
        (1, "My name is Anna Berg. I'm 34 years old, I live in Paris, France. I work as a nurse."), (2, "my wife Clara sings; My best friend Tom called. My sister's name is Eva"),
        (3, "I have 2 cats. I've been painting for 10 years. I hate the cold rooms and."), (4, None), (5, ""), (6, "Nothing is told here."),
    ]
    got = {(r["id"], r["content"]) for r in extraction.extracted(spark.createDataFrame(texts, "id int, text string"), "id", "text").collect()}
    assert got >= {(1, "name: Anna Berg"), (1, "age: 34"), (1, "occupation: nurse"), (2, "partner: Clara"), (2, "friend: Tom"), (3, "family: 2 cats"), (3, "experience: painting 10 years"), (3, "dislike: cold rooms")}
    assert any(i == 1 and c.startswith("location: Paris France") for i, c in got)
    assert {i for i, _ in got} == {1, 2, 3}


@pytest.mark.parametrize("new, known, negation, change, singular", [
    ("like: green tea", "dislike: green tea", 0.8, None, None), ("age: 25 years", "age: 30 years", None, 0.85, 0.75), ("name: the boss", "name: eva", None, None, None),
    ("she has 3 cats now", "she has 4 cats now", None, 0.7, None), ("a", "b", None, None, None), ("location: oslo", "location: oslo", None, None, None),
])
def test_conflicts(spark, new, known, negation, change, singular):
    row = spark.range(1).select(rules.contrary(F.lit(new), F.lit(known)), rules.value_change(F.lit(new), F.lit(known)), rules.singular_conflict(F.lit(new), F.lit(known))).first()
    assert tuple(row) == (negation, change, singular)


def test_greedy_matches_equal_picking_the_best_again_and_again(spark):
    rng = np.random.default_rng(0)
    rows = sorted({(min(a, b), max(a, b)) for a, b in rng.integers(0, 40, (150, 2)).tolist() if a != b})
    rows = [(a, b, float(rng.integers(1, 8)) / 8) for a, b in rows]
    used, want = set(), []
    for a, b, s in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if a not in used and b not in used:
            used |= {a, b}
            want.append((a, b, s))
    df = spark.createDataFrame(rows, "a long, b long, score double")
    assert [tuple(r) for r in conversations.greedy_matches(df, 10).collect()] == want[:10]
    assert conversations.greedy_matches(df.limit(0)).count() == 0


def _texts(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 30, int(rng.integers(1, 12))))) for i in range(60)]
    return spark.createDataFrame([*rows, (100, rows[0][1]), (101, ""), (102, None)], "id long, content string")


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.75])
def test_similar_pairs_against_brute_force(spark, threshold):
    df = _texts(spark)
    counts: dict[int, dict[str, int]] = {}
    for r in pairs.term_counts(df, "id", "content").collect():
        counts.setdefault(r["id"], {})[r["term"]] = r["tf"]
    c2, want = (1 + math.log(1.5)) ** 2, {}
    for a in counts:
        for b in counts:
            both = counts[a].keys() & counts[b].keys()
            if a < b and both:
                sa, sb = (sum(counts[x][t] ** 2 for t in both) for x in (a, b))
                na, nb = (sum(v * v for v in counts[x].values()) for x in (a, b))
                s = sum(counts[a][t] * counts[b][t] for t in both) / math.sqrt((sa + c2 * (na - sa)) * (sb + c2 * (nb - sb)))
                if s > threshold:
                    want[a, b] = round(s, 9)
    assert {(r["a"], r["b"]): round(r["similarity"], 9) for r in pairs.similar_pairs(df, "id", "content", threshold).collect()} == want
    assert (0, 100) in want


def test_vectors(spark):
    df = _texts(spark)
    v = vectors.tfidf(df, "id", "content")
    dense = {r["id"]: np.array(r["vector"]) for r in vectors.dense(v).collect()}
    assert all(abs(np.linalg.norm(x) - 1) < 1e-9 and len(x) == vectors.SLOTS for x in dense.values()) and 101 not in dense and 102 not in dense
    want = {(a, b) for a in dense for b in dense if a < b and dense[a] @ dense[b] >= 0.6}
    got = {(r["a"], r["b"]): r["cosine"] for r in vectors.similar(v, 0.6).collect()}
    assert set(got) == want and abs(got[0, 100] - 1) < 1e-9
    near = vectors.nearest(v.where("id = 0"), v, 3).orderBy("place").collect()
    assert [r["id"] for r in near][:2] == [0, 100]
    row = spark.range(1).select(vectors.distance_score(F.lit(1.0)), vectors.distance_score(F.lit(0.25))).first()
    assert tuple(row) == (0.0, 0.25)


def test_merged_hits(spark):
    text = spark.createDataFrame([(1, 1), (2, 2)], "id long, place int")
    near = spark.createDataFrame([(2, 0.5), (3, 0.9)], "id long, score double")
    got = {r["id"]: (round(r["text_score"], 6), r["vector_score"], round(r["score"], 6)) for r in vectors.merged(text, near, 0.2, 0.8).collect()}
    assert got == {1: (1.0, 0.0, 0.2), 2: (round(2 / 3, 6), 0.5, round(0.2 * 2 / 3 + 0.4, 6)), 3: (0.0, 0.9, 0.72)}
    added = {r["id"]: round(r["score"], 6) for r in vectors.added(text, near, spark.createDataFrame([(2,), (3,)], "id long")).collect()}
    assert added == {2: round(0.3 * 0.5 + 0.35, 6), 3: 0.63}


def test_expansions(spark):
    q = spark.createDataFrame([(1, "A dragon and a serpent"), (2, "tea"), (3, None)], "id int, q string")
    got = {(r["id"], r["term"], r["synonym"]) for r in search.expansions(q, "id", "q").collect()}
    assert got == {(1, "dragon", "wyrm"), (1, "serpent", "wyrm")}
    own = search.expansions(q, "id", "q", [("tea", "chai", "brew")], 1)
    assert [tuple(r) for r in own.collect()] == [(2, "tea", "brew", 1)]
