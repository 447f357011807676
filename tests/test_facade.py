"""The facade over the test tables."""

from pyspark.sql import functions as F

from memloom.facade import Memory
from memloom.operators import conversations
from memloom.plans.views import episodes, facts

SF = "/root/testdata/sf0.001"


def test_facade(spark):
    memory = Memory(spark, facts(spark, SF), episodes(spark, SF))
    got = memory.remember("the sch en", 4).collect()
    assert {r["kind"] for r in got} == {"fact", "episode"} and len(got) <= 8
    assert memory.remember("").count() == 0
    assert memory.recent(3).count() == 3
    assert memory.profile(2).groupBy("fact_type").count().agg(F.max("count")).first()[0] <= 2
    text = memory.injection("the en", budget=3000).first()
    assert text["text"].startswith("What is known:\n- ") and text["tokens"] == len(text["text"]) // 4
    assert memory.injection("zzzzzz").first()["text"] == ""
    assert memory.usage().count() == 2
    first = memory.facts.orderBy("id").first()
    more = memory.learn(spark.createDataFrame([(-1, first["content"]), (-2, "plays the cello on quiet Sunday evenings")], "id long, content string"))
    assert more.facts.count() == memory.facts.count() + 1
    assert more.facts.where(F.col("id") == first["id"]).first()["confirmation_count"] == first["confirmation_count"] + 1
    gone = memory.forget(memory.facts.where(F.col("id") == first["id"]))
    assert gone.facts.where(F.col("id") == first["id"]).first()["is_superseded"]


def test_chunks_and_clusters(spark):
    rows = [(1, i, "rain sun snow fog" if i < 6 else "piano cello violin harp") for i in range(12)] + [(2, 0, "one")]
    out = conversations.chunks(spark.createDataFrame(rows, "c long, t long, x string"), "c", "t", "x")
    assert [r["chunk"] for r in out.where("c = 1").orderBy("t").collect()] == [0] * 6 + [1] * 6 or out.where("c = 1").agg(F.max("chunk")).first()[0] >= 1
    sets = spark.createDataFrame([("g", 1, ["a", "b", "c"]), ("g", 2, ["a", "b"]), ("g", 3, ["x"])], "g string, id long, w array<string>")
    assert {r["id"]: r["cluster"] for r in conversations.clusters(sets, "g", "id", "w").collect()} == {1: 0, 2: 0, 3: 1}
    pairs = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8), (3, 4, 0.7)], "a long, b long, score double")
    assert [tuple(r) for r in conversations.greedy_matches(pairs).collect()] == [(1, 2, 0.9), (3, 4, 0.7)]
