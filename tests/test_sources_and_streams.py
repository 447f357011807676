"""Export readers, learning and streams on small files."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from memloom.functions.temporal import parse
from memloom.operators import learning
from memloom.sources import exports
from memloom.streaming import events as ev

SF = "/root/testdata/sf0.001"


def test_exports(spark, tmp_path):
    chat = [{"uuid": "c1", "name": "n", "created_at": "2024-01-02T03:04:05.123456789Z", "chat_messages": [{"sender": "human", "text": "hi", "content": []}, {"sender": "assistant", "text": "", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}, {"sender": "human", "text": " "}]}, {"uuid": "c2", "chat_messages": None}]
    tree = [{"title": "t", "conversation_id": "x", "mapping": {"1": {"message": {"author": {"role": "user"}, "content": {"parts": ["I", "live"]}}}, "2": {"message": None}}}]
    memory = [{"conversations_memory": "first words.\n**Work**\nWrites code. Likes tea!\n\n**Home**\nHas a cat."}]
    paths = {}
    for name, data in (("chat", chat), ("tree", tree), ("memory", memory), ("other", {"a": 1}), ("projects", [{"name": "p", "description": "d", "docs": [{"content": "x"}]}])):
        paths[name] = str(tmp_path / f"{name}.json")
        (tmp_path / f"{name}.json").write_text(json.dumps(data))
    assert [exports.detect_kind(spark, paths[n]) for n in ("chat", "tree", "memory", "projects", "other")] == ["conversations", "tree_conversations", "memories", "projects", "unknown"]
    rows = {r["id"]: r for r in exports.read_chat(spark, paths["chat"]).collect()}
    assert [tuple(m) for m in rows["c1"]["messages"]] == [("user", "hi"), ("assistant", "a\nb")] and rows["c2"]["messages"] == []
    assert [r["content"] for r in exports.read_tree(spark, paths["tree"]).collect()] == ["I live"]
    got = {(r["category"], r["content"]) for r in exports.read_memories(spark, paths["memory"]).collect()}
    assert got == {("general", "first words."), ("Work", "Writes code."), ("Work", "Likes tea!"), ("Home", "Has a cat.")}
    assert exports.read_projects(spark, paths["projects"]).first()["documents"] == 1
    at = spark.createDataFrame([("2024-01-02T03:04:05.123456789Z",), ("nonsense",)], "t string").select(exports.timestamp(F.col("t"), F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")).alias("t")).collect()
    assert [r["t"] for r in at] == [datetime(2024, 1, 2, 3, 4, 5, 123456), datetime(2000, 1, 1)]


def test_snapshot_and_restore(spark, tmp_path):
    store = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    path = exports.write_snapshot(store, str(tmp_path), 1)
    back = exports.restore(store.where("id = 1").withColumn("v", F.lit("new")), spark.read.parquet(path), "id")
    assert sorted(map(tuple, back.collect())) == [(1, "new"), (2, "b")]


def test_learning(spark):
    store = spark.createDataFrame([(1, "lives near the harbour in Lisbon", 0.8, 1)], "id long, content string, confidence double, confirmation_count long")
    rows = spark.createDataFrame([(2, "Lives near the harbour in Lisbon"), (3, "plays cello every Sunday evening"), (4, "plays cello every Sunday evening!")], "id long, content string")
    got = {r["id"]: (round(r["confidence"], 6), r["confirmation_count"]) for r in learning.insert_or_confirm(store, rows).collect()}
    assert got == {1: (0.9, 2), 3: (0.9, 2)}
    said = spark.createDataFrame([("I live in Oslo now. The sky is grey. I work at sea!",)], "t string")
    assert sorted(r["statement"] for r in learning.statements(said, "t").collect()) == ["I live in Oslo now", "I work at sea"]
    assert spark.createDataFrame([("Since you live in Oslo",)], "t string").select(learning.first_person(F.col("t"))).first()[0] == "Since I live in Oslo"
    one = spark.range(1)
    assert one.select(learning.merged_messages(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("B"), F.lit("c")))).first()[0] == ["a", "b", "c"]
    assert one.select(learning.suggested_tags(F.lit("Code and #Tea at work"))).first()[0] == ["work", "code", "tea"]
    items = F.array(*(F.struct(F.lit(i).cast("long").alias("id"), F.lit(t).cast("long").alias("tokens")) for i, t in ((1, 60), (2, 50), (3, 10), (4, 40))))
    assert one.select(learning.packed(items, 100)).first()[0] == [1, 4]


def test_time_phrases():
    now = datetime(2024, 2, 1, 12)
    assert parse("what did i say yesterday", now) == (datetime(2024, 1, 31), datetime(2024, 2, 1))
    assert parse("3 days ago", now) == (datetime(2024, 1, 29), datetime(2024, 1, 30))
    assert parse("last week", now) == (datetime(2024, 1, 22), datetime(2024, 1, 29))
    assert parse("last month", now) == (datetime(2024, 1, 1), datetime(2024, 2, 1))
    assert parse("in October 2022", now) == (datetime(2022, 10, 1), datetime(2022, 11, 1))
    assert parse("in october", now) == (datetime(2023, 10, 1), datetime(2023, 11, 1))
    assert parse("tea", now) is None


def test_streams_equal_batches(spark, tmp_path):
    batch = spark.read.parquet(f"{SF}/events.parquet")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = lambda: ev.read_events(spark, str(tmp_path / "in"), batch.schema)
    for name, df, mode in (("counts", ev.counts_by_window(stream(), late="60 days"), "complete"), ("seen", ev.presence(stream()), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("seen").collect())) == sorted(map(tuple, batch.groupBy("user_id").agg(F.max("ts")).collect()))
    assert spark.table("counts").agg(F.sum("n")).first()[0] == batch.count()


def test_learning_loop(spark, tmp_path):
    spark.createDataFrame([(2, "likes long walks by the river"), (3, "drinks green tea at noon")], "id long, content string").write.parquet(str(tmp_path / "in"))
    state = {"store": spark.createDataFrame([(1, "likes long walks by the river", 0.8, 1)], "id long, content string, confidence double, confirmation_count long")}

    def save(df, number):
        path = str(tmp_path / f"v{number}")
        df.write.mode("overwrite").parquet(path)
        state["store"] = spark.read.parquet(path)

    q = ev.learn(spark.readStream.schema("id long, content string").parquet(str(tmp_path / "in")), str(tmp_path / "cp"), lambda: state["store"], save)
    q.awaitTermination(120)
    assert {r["id"]: r["confirmation_count"] for r in state["store"].collect()} == {1: 2, 3: 1}
