"""Operators on small tables with values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from memloom.functions import rules
from memloom.functions import scoring as sc
from memloom.functions.sentiment import with_sentiment, with_topic
from memloom.functions.text import terms, week_key, words
from memloom.operators import graph, pairs, search, stores, windows


def one(df, *cols):
    row = df.first()
    return row[0] if not cols else tuple(row[c] for c in cols)


def test_tokens(spark):
    df = spark.createDataFrame([("The Café, naïve_1 a X!",), (None,)], "t string")
    assert [r[0] for r in df.select(words(F.col("t"))).collect()] == [["the", "café", "naïve_1", "a", "x"], []]
    assert [r[0] for r in df.select(terms(F.col("t"))).collect()] == [["café", "naïve_1"], []]


@pytest.mark.parametrize("day, week", [("2024-01-01", "2024-W01"), ("2024-12-30", "2024-W53"), ("2023-01-01", "2023-W00"), ("2023-01-02", "2023-W01")])
def test_week_key(spark, day, week):
    assert one(spark.sql(f"SELECT DATE '{day}' AS d").select(week_key(F.col("d")))) == week


def test_strength(spark):
    df = spark.range(1)
    got = one(df.select(sc.adaptive_strength(F.lit(100.0), F.lit(0.5), F.lit(3), F.lit(0.0), F.lit(0))))
    half = 168 * 2 * (1 + 0.5 * math.log(4))
    assert abs(got - (0.5 * 0.5 ** (100 / half) + 0.02)) < 1e-12
    assert one(df.select(sc.hours_until(0.01, F.lit(1.0), F.lit(0.5), F.lit(0), F.lit(0.0), F.lit(0)))) is None
    assert one(df.select(sc.fact_decay(F.lit(None).cast("double"), F.lit(1)))) == 1.0


def test_quality(spark):
    df = spark.createDataFrame([("I live in Vancouver and work there",), ("what?",), ("import os {}",)], "t string")
    assert [round(r[0], 6) for r in df.select(sc.fact_text_quality(F.col("t"))).collect()] == [0.9, 0.2, 0.3]


def test_sentiment_and_topic(spark):
    df = spark.createDataFrame([("happy and glad",), ("not happy",), ("nothing here at all",), (None,)], "t string")
    got = [(r["emotion"], r["matches"], round(r["sentiment"], 6)) for r in with_sentiment(df, "t").collect()]
    assert got == [("joy", 2, 0.4), ("joy", 1, -0.14), ("neutral", 0, 0.0), ("neutral", 0, 0.0)]
    assert [r["category"] for r in with_topic(spark.createDataFrame([("python code for a novel",), ("",)], "t string"), "t").collect()] == ["technical", "general"]


def test_contradiction(spark):
    df = spark.createDataFrame([(["i", "love", "tea"], ["i", "hate", "tea"]), (["i", "drink", "tea"], ["i", "never", "drink", "tea"]), (["a"], ["b"])], "a array<string>, b array<string>")
    no = F.lit(False)
    assert [r[0] for r in df.select(rules.contradiction(F.col("a"), F.col("b"), no, no, no)).collect()] == [0.35, 0.35, None]


def test_upsert_and_delete(spark):
    store = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    rows = spark.createDataFrame([(2, "B", 5), (3, "C", 6)], "id long, v string, more long")
    assert sorted(map(tuple, stores.upsert(store, rows, "id").collect())) == [(1, "a", None), (2, "B", 5), (3, "C", 6)]
    assert stores.delete(store, rows, "id").count() == 1
    assert stores.like_pattern("50%_x") == "%50\\%\\_x%"


def test_prefix_budget_stops_at_the_first_overflow(spark):
    df = spark.createDataFrame([("g", 1, 5), ("g", 2, 9), ("g", 3, 1)], "g string, i int, c int")
    assert [r["i"] for r in windows.prefix_budget(df, ["g"], [F.asc("i")], F.col("c"), 10).collect()] == [1]


def test_anniversaries(spark):
    df = spark.sql("SELECT * FROM VALUES (1, DATE '2022-03-02'), (2, DATE '2020-02-29'), (3, DATE '2023-01-01'), (4, DATE '2023-03-01') AS t(i, d)")
    assert sorted(r["i"] for r in windows.anniversaries(df, "d", F.lit("2023-03-01").cast("date")).collect()) == [1]


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.75, 0.9])
def test_similar_pairs_lose_nothing(spark, threshold):
    import random
    from collections import Counter

    rnd = random.Random(4)
    texts = [" ".join(rnd.choice(["rain", "sun", "snow", "fog", "storm", "hail", "ice", "heat"]) for _ in range(rnd.randint(1, 9))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {(r["a"], r["b"]) for r in pairs.similar_pairs(df, "id", "t", threshold).collect()}
    want, c = set(), 1 + math.log(1.5)
    for a in range(60):
        for b in range(a + 1, 60):
            x, y = Counter(texts[a].split()), Counter(texts[b].split())
            weight = lambda n, other: {t: k * (1 if t in other else c) for t, k in n.items()}
            p, q = weight(x, y), weight(y, x)
            cos = sum(p[t] * q[t] for t in p if t in q) / math.sqrt(sum(v * v for v in p.values()) * sum(v * v for v in q.values()))
            if cos > threshold + 1e-12:
                want.add((a, b))
    assert got == want


def test_expansion():
    assert search.expanded(["Dragon", "tea"]) == ["dragon", "tea", "serpent", "wyrm"]


def test_mmr_prefers_the_other(spark):
    rows = [("q", 1, 1.0, [1.0, 0.0]), ("q", 2, 0.99, [1.0, 0.01]), ("q", 3, 0.5, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "query string, id long, score double, vector array<double>")
    assert [r["id"] for r in search.mmr(df, "query", 2).orderBy("place").collect()] == [1, 3]


def test_graph(spark):
    links = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.9), (3, 4, 0.1), (9, 8, 1.0)], "source long, target long, weight double")
    assert sorted(map(tuple, graph.neighbourhood(links, 1, 3).collect())) == [(1, 0), (2, 1), (3, 2)]
    assert graph.shortest_path(links, 1, 4).first()["path"] == [1, 2, 3, 4]
    assert {r["node"]: r["chain"] for r in graph.chains(spark, links).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8}


def test_relations_of_all_facts_equal_every_pair(spark, tmp_path):
    import random

    from pyspark.sql import functions as F

    from memloom.functions import rules
    from memloom.functions.text import words
    from memloom.plans import QUERIES
    from memloom.plans.views import stated_facts as facts

    rnd, sf = random.Random(4), str(tmp_path)
    said = ["happy", "sad", "not", "never", "good", "bad", *(f"word{i}" for i in range(60))]
    rows = [(c, t, "user", " ".join(rnd.sample(said, rnd.randint(0, 14)))) for c in range(60) for t in range(3)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{sf}/conversations.parquet")
    f = facts(spark, sf).withColumn("w", F.array_distinct(words(F.col("content"))))
    a, b = (f.select(*(F.col(c).alias(f"{k}_{c}") for c in ("id", "fact_type", "category", "is_superseded", "source_episode", "w"))) for k in "ab")
    p = a.crossJoin(b).where("a_id < b_id")
    topic, kind, old = F.col("a_category") == F.col("b_category"), F.col("a_fact_type") == F.col("b_fact_type"), F.col("a_is_superseded") | F.col("b_is_superseded")
    far = 0
    for name, c in (("x11_contradictions_of_all_facts", rules.contradiction(F.col("a_w"), F.col("b_w"), topic, kind, old)), ("x12_elaborations_of_all_facts", rules.elaboration(F.col("a_w"), F.col("b_w"), topic, kind))):
        want = {(r["a_id"], r["b_id"]): (round(r["c"], 5), r["far"]) for r in p.withColumn("c", c).where("c is not null").select("a_id", "b_id", "c", F.expr("a_source_episode <> b_source_episode").alias("far")).collect()}
        assert {(r["a"], r["b"]): round(r["confidence"], 5) for r in QUERIES[name](spark, sf).collect()} == {k: v[0] for k, v in want.items()}
        far += sum(v[1] for v in want.values())
    assert far > 0


def test_opposite_words_pair_without_other_likeness(spark):
    from memloom.operators import pairs

    sets = spark.createDataFrame([(1, ["happy", "x"]), (2, ["sad", "y"]), (3, ["unhappy"]), (4, ["z"])], "id long, w array<string>")
    assert {tuple(r) for r in pairs.opposite_pairs(sets, [("happy", "sad"), ("happy", "unhappy")]).collect()} == {(1, 2), (1, 3)}
