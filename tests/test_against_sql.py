"""Queries against their SQL on small tables made for what the test tables don't hold."""

import time

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from memloom.operators import blocks, graph, pairs
from memloom.operators.conversations import _clustered, clusters
from memloom.plans import ORACLE_SQL, QUERIES


def conversations(path, rows):
    """A folder with a table of conversations: rows (conv_id, turn, role, text)."""
    cols = zip(*rows, strict=True)
    kinds = (pa.int64(), pa.int32(), pa.string(), pa.string())
    pq.write_table(pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["conv_id", "turn", "role", "text"]), path / "conversations.parquet")
    return str(path)


def same_as_sql(spark, folder, name):
    """The query's rows, which must be those of its SQL to the last digit."""
    df = QUERIES[name](spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    result = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    want = sorted(result.fetchall())
    got = sorted(tuple(r) for r in df.select(*names).collect())
    assert got == want
    return got


@pytest.fixture(scope="module")
def alike(tmp_path_factory):
    """Conversations of few words: many summaries begin alike or are alike, at times far apart, the later id often the earlier."""
    rng = np.random.default_rng(5)
    text = lambda n: " ".join(f"w{x}" for x in rng.zipf(1.6, n) % 25)
    rows = [(int(c), t, "user" if t % 2 == 0 else "assistant", text(int(rng.integers(3, 9)))) for c in range(0, 400, 5) for t in range(2)]
    rows += [(401, 0, "user", None), (402, 0, "user", ""), (403, 0, "assistant", "w1 w2 w3"), (404, 0, "user", "a the of")]
    return conversations(tmp_path_factory.mktemp("alike"), rows)


@pytest.mark.parametrize("name", ["d03_episode_duplicates", "j09_merge_candidates"])
def test_episode_pairs_whose_later_id_is_earlier(spark, alike, name):
    assert len(same_as_sql(spark, alike, name)) > 20


ALL_PAIRS = (
    "a20_duplicate_stats", "d01_similar_pairs", "d02_corpus_cosine", "d04_fact_duplicates", "d07_smart_duplicates", "g06_similarity_links", "j05_episode_duplicates", "j06_duplicate_facts",
    "j07_relations_of_all_facts", "x11_contradictions_of_all_facts", "x12_elaborations_of_all_facts", "d03_episode_duplicates", "j09_merge_candidates",
)


@pytest.mark.parametrize("name", ALL_PAIRS)
def test_all_pairs_over_many_chunks(spark, alike, name, monkeypatch):
    for limit, value in (("CHUNK", 37), ("LEAST", 60), ("HEAD", 5)):
        monkeypatch.setattr(blocks, limit, value)
    assert same_as_sql(spark, alike, name)


@pytest.mark.parametrize("name", ["a20_duplicate_stats", "d01_similar_pairs", "d02_corpus_cosine", "d03_episode_duplicates", "g06_similarity_links", "j05_episode_duplicates", "j07_relations_of_all_facts", "j09_merge_candidates"])
def test_no_pair_is_shuffled(spark, alike, name):
    plan = QUERIES[name](spark, alike)._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and "CartesianProduct" in plan


def test_counts_beyond_floats_of_32_bits(spark):
    rows = [(1, ["a"] * 5000 + ["b"]), (2, ["a"] * 5001), (3, ["a"] * 4999 + ["c"] * 3), (4, ["c"]), (5, [])]
    df = spark.createDataFrame([(i, " ".join(f"{x}{x}" for x in w)) for i, w in rows], "id long, t string")
    got = {(r["a"], r["b"]): r["similarity"] for r in pairs.similar_pairs(df, "id", "t", 0.001).collect()}
    c = pairs.UNIQUE**2
    want = {(1, 2): 5000 / (25_000_000 + c) ** 0.5, (1, 3): 5000 * 4999 / ((25_000_000 + c) * (4999**2 + 9 * c)) ** 0.5, (2, 3): 4999 / (4999**2 + 9 * c) ** 0.5, (3, 4): 3 / (9 + c * 4999**2) ** 0.5}
    assert got.keys() == {p for p in want if want[p] > 0.001} and all(abs(got[p] - want[p]) < 1e-12 for p in got)


def test_clusters_equal_walking_every_open_row(spark):
    """And a group of some thousand rows takes seconds, where the walk took a minute."""
    rng = np.random.default_rng(8)
    some = [(i % 2, i, sorted({f"w{x}" for x in rng.zipf(1.3, int(rng.integers(0, 25))) % 300})) for i in range(300)]
    want = {}
    for g in (0, 1):
        rows, number = sorted(((i, set(w)) for k, i, w in some if k == g), key=lambda r: (-len(r[1]), r[0])), 0
        for at, (seed, words) in enumerate(rows):
            if seed not in want:
                want[seed], united = number, set(words)
                for other, theirs in rows[at + 1 :]:
                    if other not in want and united | theirs and len(united & theirs) / len(united | theirs) >= 0.2:
                        want[other], united = number, united | theirs
                number += 1
    assert {r["id"]: r["cluster"] for r in clusters(spark.createDataFrame(some, "g int, id long, w array<string>"), "g", "id", "w").collect()} == want
    sizes = np.full(6_000, 12)
    words, began = np.sort(rng.integers(0, 50_000, (6_000, 12)), axis=1).ravel(), time.time()
    place = _clustered(sizes, words, np.repeat(np.arange(6_000), 12), 0.2)
    assert place.max() > 4_000 and time.time() - began < 10


def test_shortest_path_ties_are_ordered_as_text(spark):
    links = spark.createDataFrame([(4, 9, 1.0), (4, 10, 1.0), (9, 3, 1.0), (10, 3, 1.0), (3, 75, 1.0)], "source long, target long, weight double")
    assert graph.shortest_path(links, 4, 75).first()["path"] == [4, 10, 3, 75]
