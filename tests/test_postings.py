"""Stored indexes: equal to a search of the texts, kept up by commits, and reading only what is asked."""

from memloom.operators import search, vectors
from memloom.operators.postings import TextIndex, VectorIndex

TEXTS = {1: "Alpha beta gamma", 2: "beta beta delta", 3: "", 4: None, 5: "über alphabet soup", 6: "gamma delta gamma epsilon zeta", 7: "AL al ale"}
ASKED = ["al", "beta", "ü", "gamma", "nothing"]


def rows(spark, texts):
    return spark.createDataFrame(list(texts.items()), "id long, content string")


def scores(df):
    return {r["id"]: round(r["score"], 9) for r in df.collect()}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_index_follows_its_table(spark, tmp_path):
    index = TextIndex(spark, f"file://{tmp_path}/i")
    assert not index.built
    index.build(rows(spark, TEXTS), "id", "content")
    now = dict(TEXTS)

    def holds():
        for asked in (ASKED, ["a"], ["nothing"]):
            assert scores(index.bm25(asked)) == scores(search.bm25(spark, rows(spark, now), "id", "content", asked))

    holds()
    change = {2: "alpha once more", 8: "beta for the first time", 3: "gammas"}
    index.upsert(rows(spark, change), "id", "content")
    now |= change
    holds()
    index.delete(rows(spark, {1: "", 8: "", 99: ""}), "id")
    now = {k: v for k, v in now.items() if k not in (1, 8)}
    holds()
    index.upsert(rows(spark, {1: "alpha again", 2: "beta"}), "id", "content")
    now |= {1: "alpha again", 2: "beta"}
    holds()
    assert index.versions.entry()["meta"]["n"] == len(now)
    index.compact()
    holds()
    assert len(index.versions.parts("postings")) == 1 and not index.versions.parts("gone")
    index.delete(rows(spark, now), "id")
    assert scores(index.bm25(ASKED)) == {}


def test_search_reads_the_asked_buckets(spark, tmp_path):
    index = TextIndex(spark, f"file://{tmp_path}/i")
    index.build(rows(spark, TEXTS), "id", "content")
    plan = plan_of(index.hits(["beta", "gamma"]))
    assert "PartitionFilters: [bucket" in plan and "StringStartsWith(term,beta)" in plan and "content" not in plan


def test_vector_index(spark, tmp_path):
    index = VectorIndex(spark, f"file://{tmp_path}/v")
    df = rows(spark, {k: v or "" for k, v in TEXTS.items()})
    index.build(df, "id", "content")
    asked = rows(spark, {100: "gamma delta", 101: "alphabet zeta unknown", 102: "unknown"})
    want = vectors.nearest(vectors.tfidf(asked, "id", "content", df), vectors.tfidf(df, "id", "content"), 3)
    key = lambda x: {(r["query"], r["place"]): (r["id"], round(r["score"], 9)) for r in x.collect()}
    got = index.nearest(index.embed(asked, "id", "content"), 3)
    assert key(got) == key(want) and len(key(want)) >= 3
    assert "PartitionFilters: [group" in plan_of(got)
