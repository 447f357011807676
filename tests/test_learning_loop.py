"""The learning loop: what a batch changes, and that a stream of sessions with a restart equals batches."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from memloom.operators.learning import learned
from memloom.sources.versions import Versions
from memloom.streaming import sessions as st

KNOWN = [
    (1, "my job: baker at the old mill", 0.5, 1, False), (2, "I live in Paris near the river and I love my old house", 0.5, 2, False),
    (3, "I like cold coffee in the morning sun", 0.5, 1, False), (4, "location: oslo", 0.5, 1, True),
]


def store(spark, rows=KNOWN):
    return spark.createDataFrame(rows, st.STORE)


def test_a_batch_of_messages(spark):
    said = [
        (10, "user", "My name is Anna Berg and I work as a nurse in Oslo. I'm stuck on this () => thing"), (11, "user", "I live in Paris near the river and I love my old house"),
        (12, "user", "I dislike cold coffee in the morning sun, I live near Oslo"), (13, "assistant", "You work as a nurse in the North Hospital. Nice weather"), (14, "system", "I live in a Computer"), (15, "user", None),
    ]
    got = learned(store(spark), spark.createDataFrame(said, "id long, role string, text string"))
    changed = {r["id"]: r for r in got.changed.collect()}
    assert changed[2]["confirmation_count"] == 3 and changed[2]["confidence"] == pytest.approx(0.6)  # told again
    assert changed[3]["is_superseded"] and changed[12000]["content"].startswith("I dislike cold coffee")  # contradicted
    assert changed[10000]["content"] == "My name is Anna Berg and I work as a nurse in Oslo" and not changed[10000]["is_superseded"]
    assert changed[13000]["content"] == "I work as a nurse in the North Hospital"
    assert 1 not in changed and not any(k // 1000 in (14, 15) for k in changed)
    links = {(r["source"], r["target"]) for r in got.links.collect()}
    assert (12000, 3) in links and all(a in changed for a, _ in links)
    assert all(0.4 <= r["quality"] < 0.7 for r in got.pending.collect())


MESSAGES = [(c, c * 100 + n, "user", f"I live in Town{c} and my job number {n} is Baker{c}x{n} of street{n * 7}", datetime(2024, 1, 1, 8) + timedelta(minutes=n * (1 if n < 25 else 3))) for c in (1, 2, 3) for n in range(28)]
MESSAGES += [(1, 150, "user", "I moved to Harbor City last year with my dog", datetime(2024, 1, 1, 15)), (9, 901, "user", "hello there my friend", datetime(2024, 1, 2, 12))]
SCHEMA = "conversation long, id long, role string, text string, at timestamp"


def plain_sessions():
    out = {}
    for c in (1, 2, 3, 9):
        held, n, last = [], 0, None
        for m in sorted((m for m in MESSAGES if m[0] == c), key=lambda m: m[4]):
            if held and m[4] - last > timedelta(minutes=30):
                out[c, n], held, n = [x[1] for x in held], [], n + 1
            held.append(m)
            last = m[4]
            if len(held) == 20:
                out[c, n], held, n = [x[1] for x in held], [], n + 1
        if held and c != 9:  # the last stays open: nothing later moves the watermark past it
            out[c, n] = [x[1] for x in held]
    return out


def test_sessions_and_learning_with_a_restart(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = f"file://{tmp_path}/in"
    in_order = sorted(MESSAGES, key=lambda m: m[4])
    parts = [in_order[:30], in_order[30:70], in_order[70:]]

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        q = st.learn_sessions(spark, st.sessions(stream), f"file://{tmp_path}/store", f"file://{tmp_path}/check")
        q.awaitTermination(240)
        assert not q.isActive and q.exception() is None

    seen = {}

    def told(session, versions, messages, number):
        """In place of learning: what each commit gets."""
        assert number not in seen
        seen[number] = sorted(r["id"] for r in messages.collect())
        return versions.commit([versions.write("facts", messages.select("id"))], meta={"batch": number})

    real, st.learn_batch = st.learn_batch, told
    try:
        for part in parts:  # a stop and a restart from the checkpoint after each file
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
            run()
        store = Versions(spark, f"file://{tmp_path}/store")
        before = store.latest()
        run()  # nothing new: no commit
        assert store.latest() == before
    finally:
        st.learn_batch = real
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want = plain_sessions()
    assert sorted(i for ids in seen.values() for i in ids) == sorted(i for ids in want.values() for i in ids)  # each message once
    assert sorted(r["id"] for r in store.read("facts").collect()) == sorted(i for ids in want.values() for i in ids)
    assert len(seen) > 1 and max(map(len, want.values())) == 20


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    versions = Versions(spark, path)
    messages = spark.createDataFrame([(10, "user", "My name is Anna Berg and I work as a nurse in Oslo")], "id long, role string, text string")
    assert st.learn_batch(spark, versions, messages, 4) == 1
    assert [tuple(r) for r in versions.live("facts").select("id", "confirmation_count", "is_superseded").collect()] == [(10000, 1, False)]
    session = spark.createDataFrame([(1, 0, "idle", [(10, "user", "My name is Anna Berg and I work as a nurse in Oslo", datetime(2024, 1, 1))])], st.SESSION)
    st.step_of(spark, versions)(session, 4)  # the number that was committed
    assert versions.latest() == 1
    st.step_of(spark, versions)(session, 5)  # told again: confirmed
    assert versions.latest() == 2 and versions.live("facts").count() == 1
