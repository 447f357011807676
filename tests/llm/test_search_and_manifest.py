"""Ranked search, Merkle manifest and decontamination against plain versions, over awkward rows."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from memloom.llm import decontamination, merkle, ranked_search

from .cases import BASE, documents, low

TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, doc_id string, rank string"


def terms(text):
    return TERM.findall(low(text or ""))


def plain_search(docs, items, k):
    words = [terms(t) for _, t in docs]
    n_docs, length = sum(map(bool, words)), sum(map(len, words))
    held = {}
    for w in words:
        for t in set(w):
            held[t] = held.get(t, 0) + 1
    out = []
    for item, text in items:
        scores = []
        for (i, _), w in zip(docs, words, strict=True):
            s = 0
            for t in set(terms(text)) & set(w):
                m = 10 + 90 * len(w) * n_docs // length
                s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[t] + 1))) * (10**9 * w.count(t) // (1000 * w.count(t) + 8 * m))
            if s:
                scores.append((-s, i is not None, i, s))
        out += [(item, r, x[2], x[3]) for r, x in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("segment, block", [(1 << 21, 1 << 20), (60, 4)])
def test_ranked_search_against_plain_scores(spark, monkeypatch, segment, block):
    monkeypatch.setattr(ranked_search, "SEGMENT", segment)
    monkeypatch.setattr(ranked_search, "BLOCK", block)
    rng = np.random.default_rng(4)
    words = [f"w{x}" for x in range(60)] + ["é1", "ÀB", "ñ"]
    extra = [(1000 + i, " ".join(rng.choice(words, int(rng.integers(1, 40)))), "en", "s", 0, "", "") for i in range(300)]
    extra += [(2000 - i, "w1 w2 w3 w3", "en", "s", 0, "", "") for i in range(25)]  # ties beyond the tenth
    items = [(1, "W1 w2, w3! w3"), (2, "é1 ñ alpha"), (3, "of nothing there is unknown"), (4, None), (5, " ,; "), (6, BASE), (7, " ".join(words)), (1, "w5"), (None, "word17 W9")]
    df = documents(spark, extra)
    asked = spark.createDataFrame([(*x, "x", "x") for x in items], ITEMS)
    found = ranked_search.ranked_search(spark, df, asked)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    got = sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in found.collect()), key=repr)
    assert got == plain_search([(r["doc_id"], r["text"]) for r in df.collect()], items, 10)
    assert sum(x[0] == 2 for x in got) == 10 and [x[2] for x in got if x[0] == 7 and x[1] == 1]


def test_ranked_search_of_nothing_and_of_other_ids(spark):
    df, asked = documents(spark), spark.createDataFrame([(1, "one alpha", "", "")], ITEMS)
    assert ranked_search.ranked_search(spark, df.limit(0), asked).count() == 0
    assert ranked_search.ranked_search(spark, df, asked.limit(0)).count() == 0
    named = df.withColumn("doc_id", F.concat(F.lit("n"), F.col("doc_id").cast("string")))
    found = ranked_search.ranked_search(spark, named, asked, k=3).collect()
    assert [r["rank"] for r in sorted(found, key=lambda r: r["rank"])] == [1, 2, 3] and all(r["doc_id"].startswith("n") for r in found)


def test_search_stops_before_all_postings():
    """Two documents hold the rare term; the common one isn't worked through."""
    docs = np.concatenate([[3, 9], np.arange(1000)])
    keys = np.concatenate([[1, 1], np.zeros(1000, np.int64)])
    score = np.concatenate([[900, 800], np.full(1000, 5)]).astype(np.int64)
    order = np.lexsort((keys, docs))
    segment = ranked_search.Segment(docs[order], keys[order], score[order], np.arange(1000), 2)
    found, best = segment.search(np.array([0, 1]), 2, 1)
    assert found.tolist() == [3, 9] and best.tolist() == [905, 805]
    assert (segment.seen > 0).sum() == 2  # partial scores of two documents alone, which then got their whole scores


def sha(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def plain_leaf(*values):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes):
    """The root, and for each node what stands before and after it, level by level."""
    proofs, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for n, p in enumerate(place):
            run, at = nodes[p // 8 * 8 : p // 8 * 8 + 8], p % 8
            proofs[n].append(("".join(run[:at]), "".join(run[at + 1 :])))
        nodes = [sha(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
        place = [p // 8 for p in place]
    return nodes[0], proofs


def plain_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append((r["doc_id"], plain_leaf(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"])))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in names:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees.append(plain_tree([leaf for _, leaf in groups[g]]))
    root, upper = plain_tree([t[0] for t in trees])
    return [(i, g, leaf, t[0], root, tuple(p + u)) for g, t, u in zip(names, trees, upper, strict=True) for (i, leaf), p in zip(groups[g], t[1], strict=True)]


@pytest.mark.parametrize("per_task", [200_000, 300])
def test_manifest_against_a_plain_tree(spark, monkeypatch, per_task):
    monkeypatch.setattr(merkle, "LEAVES_PER_TASK", per_task)
    extra = [(5000 + i, f"t {i}", "de", "s", i, "", "") for i in range(4700)] + [(i, "É x", lang, None, 3, "", "") for i, lang in enumerate([None, "", "é", "z", *(f"l{n}" for n in range(9))])]
    extra += [(7, "same", "fr", "s", 4, "", "")] * 70 + [(None, None, "fr", "s", None, "", "")] * 2
    df = documents(spark, extra)
    got = merkle.merkle_manifest(spark, df.withColumn("tag", F.col("doc_id") * 2), carry=("tag",)).collect()
    want = plain_manifest(df.collect())
    assert sorted(((r["doc_id"], r["lang"], r["leaf"], r["subroot"], r["root"]) for r in got), key=repr) == sorted((x[:5] for x in want), key=repr)
    assert all(r["tag"] == (None if r["doc_id"] is None else 2 * r["doc_id"]) for r in got)
    proofs = lambda rows: sorted(((i, g, p) for i, g, p in rows), key=repr)
    assert proofs((r["doc_id"], r["lang"], tuple((s["before"], s["after"]) for s in r["proof"])) for r in got) == proofs((x[0], x[1], x[5]) for x in want)


def test_manifest_finds_what_was_changed(spark):
    df = documents(spark, [(100 + i, f"Text {i}", "de", "s", 5, "", "") for i in range(40)])
    rows = {r["doc_id"]: r for r in df.collect()}
    changed = merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.lower("text"))
    out = merkle.merkle_manifest(spark, df.withColumn("changed", changed), carry=("changed",))
    for r in out.withColumn("own", merkle.fold(F.col("leaf"), F.col("proof"))).withColumn("other", merkle.fold(F.col("changed"), F.col("proof"))).withColumn("sha", merkle.proof_digest(F.col("proof"))).collect():
        assert r["own"] == r["root"]
        if r["doc_id"] is not None and r["doc_id"] >= 100:
            assert (r["other"] == r["root"]) == (rows[r["doc_id"]]["text"] == (rows[r["doc_id"]]["text"] or "").lower())
        assert r["sha"] == sha(*(s["before"] + s["after"] for s in r["proof"]))
    assert merkle.merkle_manifest(spark, df.limit(0)).count() == 0
    one = merkle.merkle_manifest(spark, df.where("doc_id = 100")).collect()
    assert len(one) == 1 and one[0]["leaf"] == one[0]["subroot"] == one[0]["root"] and one[0]["proof"] == []
    assert zlib.crc32(b"100") == spark.sql("SELECT crc32('100') c").first()["c"]


def plain_hits(text, windows):
    w = terms(text)
    hit, items = set(), set()
    for pattern, owners in windows.items():
        for i in range(len(w) - len(pattern) + 1):
            if tuple(w[i : i + len(pattern)]) == pattern:
                hit |= set(range(i, i + len(pattern)))
                items |= owners
    return len(w), sorted(hit), sorted(items)


@pytest.mark.parametrize("windows", [400_000, 8])
def test_decontamination_against_plain_windows(spark, monkeypatch, windows):
    monkeypatch.setattr(decontamination, "WINDOWS", windows)
    passage = "Where was the first, ever-growing café built and by whom? It was (in 1850) built by two sisters, É. and Z."
    other = "nobody knew what lay beyond the hills until the river had been crossed at dawn by them"
    items = [(1, passage), (2, other), (3, "Short ANSWER"), (4, None), (5, "  !"), (10, passage), (6, "one"), (2, other), (None, "no id at all")]
    w = other.split()
    extra = [(100, f"Hm! {passage.upper()}"), (101, f"x {' '.join(w[:10])} x {' '.join(w[3:13])}"), (102, f"x {' '.join(w[:9])} y"), (103, f"a short\n\nanswer, {' '.join(w)}; short answer short answer"), (104, "shorts answer no-id, at all"), (105, " ".join(w[:10]) + "\x00" + " ".join(w[6:]))]
    df = documents(spark, [(i, t, "en", "s", 0, "", "") for i, t in extra] + [(103, extra[3][1], "en", "s", 0, "", "")])
    asked = spark.createDataFrame([(*x, "x", "x") for x in items], ITEMS)
    known = {}
    for i, t in items:
        own = terms(t)
        for k in range(max(1, len(own) - 9) if own else 0):
            known.setdefault(tuple(own[k : k + 10]), set()).add("null" if i is None else str(i))
    rows = df.collect()
    got = decontamination.decontaminate(spark, df, asked).collect()
    key = lambda x: repr(x)
    want = []
    for r in rows:
        n, hit, found = plain_hits(r["text"], known)
        marks = list(TERM.finditer(low(r["text"] or "")))
        runs = []
        for p in hit:
            if runs and runs[-1][1] == p - 1:
                runs[-1][1] = p
            else:
                runs.append([p, p])
        want.append((r["doc_id"], n, len(hit), tuple(found), tuple((a, b, marks[a].start(), marks[b].end()) for a, b in runs)))
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), tuple(tuple(s) for s in r["spans"])) for r in got), key=key) == sorted(want, key=key)
    assert sum(x[2] > 0 for x in want) >= 6
    assert decontamination.decontaminate(spark, df.limit(0), asked).count() == 0
    assert all(r["n_hit"] == 0 for r in decontamination.decontaminate(spark, df, asked.limit(0)).collect())
