"""Arrays of objects read by small byte ranges equal what json.loads gives."""

import json

import numpy as np
import pytest

from memloom.sources.json_array import json_records, read_json_array, write_json_array


@pytest.fixture
def small_ranges(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    old = {n: spark.conf.get(n, None) for n in names}
    spark.conf.set(names[0], "700b")
    spark.conf.set(names[1], "0")
    yield
    for n, v in old.items():
        spark.conf.set(n, v) if v else spark.conf.unset(n)


def made(rng, n):
    odd = ['}', '{"', '\\', '"', "[{]}", "}, {", 'a\\"}', "é😀", "\n", "", "]}"]
    text = lambda: "".join(rng.choice(odd) if rng.random() < 0.4 else "plain words " for _ in range(int(rng.integers(0, 30))))
    return [{"id": i, "name": text(), "messages": [{"text": text() * (200 if i == 7 else 1), "deep": {"x": [1, {"y": text()}]}} for _ in range(int(rng.integers(0, 4)))]} for i in range(n)]


@pytest.mark.parametrize("indent, separators", [(None, None), (2, None), (None, (",", ":"))])
def test_ranges_give_all_objects(spark, tmp_path, small_ranges, indent, separators):
    rows = made(np.random.default_rng(1), 60)
    for name, some in (("a", rows[:45]), ("b", rows[45:]), ("c", []), ("d", [{"id": 1000}])):
        (tmp_path / f"{name}.json").write_text(json.dumps(some, indent=indent, separators=separators, ensure_ascii=indent is None))
    found = json_records(spark, f"file://{tmp_path}")
    assert found.rdd.getNumPartitions() > 20 or indent is None  # one file in many tasks
    got = sorted((json.loads(r["text"]) for r in found.collect()), key=lambda x: x["id"])
    assert got == rows + [{"id": 1000}]


def test_round_trip(spark, tmp_path, small_ranges):
    df = spark.createDataFrame([(i, f'q" }} {{ {i}', [f"[{i}]"] * (i % 3)) for i in range(100)], "id long, t string, more array<string>").repartition(3)
    write_json_array(df, f"file://{tmp_path}/out")
    back = read_json_array(spark, f"file://{tmp_path}/out", "id long, t string, more array<string>")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert back.where("id = 5").first()["t"] == 'q" } { 5'
