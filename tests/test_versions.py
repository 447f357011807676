"""Versions, backups and change feeds: writers at once, restores, consumers that join midway."""

import threading

import pytest

from memloom.sources.versions import Backups, ChangeFeed, Conflict, Versions


def rows(spark, *ids):
    return spark.createDataFrame([(i, f"t{i}") for i in ids], "id long, text string")


def ids(df):
    return sorted(r["id"] for r in df.collect()) if df is not None else []


def test_versions_are_whole_and_can_be_read_again(spark, tmp_path):
    v = Versions(spark, f"file://{tmp_path}/t")
    assert v.latest() == 0 and v.read("a") is None and v.list() == []
    assert v.commit([v.write("a", rows(spark, 1, 2)), v.write("b", rows(spark, 9))], note="first", meta={"n": 2}) == 1
    assert v.commit([v.write("a", rows(spark, 3))]) == 2
    assert v.commit([v.write("a", rows(spark, 7))], replace=True) == 3
    assert [ids(v.read("a", n)) for n in (1, 2, 3)] == [[1, 2], [1, 2, 3], [7]] and ids(v.read("b", 2)) == [9] and v.read("b", 3) is None
    v.write("a", rows(spark, 100))  # never committed, never seen
    assert ids(v.read("a")) == [7] and v.entry(2)["meta"] == {"n": 2} and v.entry(3)["meta"] == {}
    assert v.restore(2) == 4 and ids(v.read("a")) == [1, 2, 3] and ids(v.read("a", 3)) == [7]
    assert [x["version"] for x in v.list()] == [4, 3, 2, 1] and v.list()[-1]["note"] == "first"
    with pytest.raises(Conflict):
        v.commit([v.write("a", rows(spark, 8))], expected=3)
    assert v.forget(1) == 1 and ids(v.read("a")) == [1, 2, 3] and v.numbers() == [4]


def test_writers_at_once_lose_nothing(spark, tmp_path):
    path, seen = f"file://{tmp_path}/t", []

    def write(k):
        v = Versions(spark, path)
        part = v.write("a", rows(spark, 2 * k, 2 * k + 1))
        seen.append(v.commit([part]))

    threads = [threading.Thread(target=write, args=(k,)) for k in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    v = Versions(spark, path)
    assert sorted(seen) == list(range(1, 7)) and ids(v.read("a")) == list(range(12))
    for n in range(1, 7):
        assert len(ids(v.read("a", n))) == 2 * n  # never half of a commit


def test_backups(spark, tmp_path):
    b = Backups(spark, f"file://{tmp_path}/b")
    first = b.create({"facts": rows(spark, 1), "episodes": rows(spark, 5)}, "before")
    second = b.create({"facts": rows(spark, 1, 2), "episodes": rows(spark, 5, 6)}, "after")
    assert [(x["version"], x["note"], x["parts"]) for x in b.list()] == [(second, "after", 2), (first, "before", 2)]
    old = b.restore(first)
    assert ids(old["facts"]) == [1] and ids(old["episodes"]) == [5] and ids(b.restore(second)["facts"]) == [1, 2]
    with pytest.raises(ValueError):
        b.restore(7)


def test_a_late_consumer_gets_a_snapshot_and_then_each_change_once(spark, tmp_path):
    feed = ChangeFeed(spark, f"file://{tmp_path}/f")
    assert feed.snapshot() == (0, None)
    feed.publish(rows(spark, 1))
    early, upto = [], 0
    feed.publish(rows(spark, 2, 3))
    upto, more = feed.after(upto)
    early += ids(more)
    at, all_so_far = feed.snapshot()  # joins midway
    late = ids(all_so_far)
    feed.publish(rows(spark, 4))
    feed.publish(rows(spark, 4, 5))
    assert feed.after(at)[0] == 4
    late += ids(feed.after(at)[1])
    upto, more = feed.after(upto)
    early += ids(more)
    assert early == late == [1, 2, 3, 4, 4, 5] and feed.after(upto) == (4, None)
    assert [r["version"] for r in feed.after(2)[1].orderBy("version").collect()] == [3, 4, 4]
