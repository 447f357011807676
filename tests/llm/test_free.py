"""The operators in Python against brute force, round trips and held-out accuracy, and over awkward rows."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from memloom.llm import cover_tree, fingerprints, graph, jaccard_join, packing, span_dedup, textvec, toxicity
from memloom.llm.wordbpe import WordTokenizer

from .cases import BASE, WORD, components, documents, low, shingles


def test_word_hashes_tell_words_apart():
    texts = ["a b", "A  b\n", "", None, "x" * 5000, "é É"]
    buf, offsets = textvec.raw(pa.array(texts))
    w = textvec.words(buf, offsets)
    assert w.counts.tolist() == [2, 2, 0, 0, 1, 2]
    h = w.hashes.tolist()
    assert h[:2] == h[2:4] and len(set(h)) == 5


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(-50, 50, (60, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(0, 5000 + i) for i in range(300)]
    got = {r["node"]: r["component"] for r in graph.components(spark, spark.createDataFrame(links, "a long, b long")).collect()}
    want = components({x for p in links for x in p}, links)
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {n: want[n] for n in linked}
    assert graph.components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def brute_jaccard(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    links = [(x, y) for x in range(len(sets)) for y in range(x) if sets[x][1] and 100 * len(sets[x][1] & sets[y][1]) >= 75 * len(sets[x][1] | sets[y][1])]
    comp = components(range(len(sets)), links)
    least = {}
    for n, c in comp.items():
        if sets[n][0] is not None:
            least[c] = min(least.get(c, sets[n][0]), sets[n][0])
    return sorted(((i, len(s), least.get(comp[n]) if s else i) for n, (i, s) in enumerate(sets)), key=repr)


@pytest.mark.parametrize("frequent, part", [(8, 2048), (2, 4)])
def test_jaccard_join_against_brute_force(spark, monkeypatch, frequent, part):
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard_join, "PART", part)
    rng = np.random.default_rng(7)
    extra = []
    for family in range(6):
        words = [f"f{family}w{rng.integers(40)}" for _ in range(60 + 20 * family)]
        for copy in range(9):
            mine = list(words)
            for _ in range(int(rng.integers(0, 5))):
                mine[int(rng.integers(len(mine)))] = f"new{rng.integers(1 << 30)}"
            extra.append((1000 + family * 50 + copy, " ".join(mine), "en", "s", 0, "", ""))
    passage = " ".join(f"shared{i}" for i in range(30))
    extra += [(2000 + i, f"{passage} " + " ".join(f"own{i}x{j}" for j in range(10 + 8 * i)), "en", "s", 0, "", "") for i in range(12)]
    df = documents(spark, extra)
    want = brute_jaccard([(r["doc_id"], r["text"]) for r in df.collect()])
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(spark, df).collect()), key=repr)
    assert got == want
    assert len({c for _, _, c in want}) < len(want) - 30


def test_jaccard_join_of_nothing(spark):
    assert jaccard_join.jaccard_components(spark, documents(spark).limit(0)).count() == 0


def test_signature_tree_finds_every_component():
    rng = np.random.default_rng(1)
    for _ in range(20):
        base = [rng.integers(1, 1 << 60, int(rng.integers(1, 80)), dtype=np.uint64) for _ in range(6)]
        sets = []
        for b in base:
            for _ in range(int(rng.integers(1, 9))):
                drop = rng.random(len(b)) < 0.15
                sets.append(np.unique(np.concatenate([b[~drop], rng.integers(1, 1 << 60, int(drop.sum()) + 1, dtype=np.uint64)])))
        links = []
        for x in range(len(sets)):
            for y in range(x):
                i = len(np.intersect1d(sets[x], sets[y]))
                if 100 * i >= 75 * (len(sets[x]) + len(sets[y]) - i):
                    links.append((x, y))
        want = components(range(len(sets)), links)
        assert dict(enumerate(jaccard_join.join_block(sets, 75, 100)[0].tolist())) == want


@pytest.mark.parametrize("part", [2048, 20])
def test_cover_trees_against_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(cover_tree, "PART", part)
    rng = np.random.default_rng(5)
    rows = []
    for c in range(12):
        center = rng.normal(size=16)
        rows += [(len(rows) + k, [float(x) for x in np.float32(center + rng.normal(size=16) * s)], c % 3) for k, s in enumerate(rng.choice([0.0, 0.05, 0.2, 0.25], 12))]
    rows += [(800 + k, [1.0 + 0.01 * k, 2.0, 3.0 + 0.3 * k], 1) for k in range(4)]  # another length
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, rows[0][1], None), (904, [float("inf")] * 16, 0), (905, rows[0][1], 0), (905, rows[0][1], 0), (906, [None] + [1.0] * 15, 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, n_links string")
    ok = [r for r in rows if r[2] is not None and r[1] is not None and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1])]
    v = np.array([np.pad(np.float32(r[1]), (0, 16 - len(r[1]))) for r in ok], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    kind = np.array([100 * len(r[1]) + r[2] for r in ok])
    close = (v @ v.T >= 0.93) & (kind[:, None] == kind[None, :])
    np.fill_diagonal(close, False)
    comp = components(range(len(ok)), [(int(a), int(b)) for a, b in np.argwhere(close)])
    least = {c: min(ok[n][0] for n in comp if comp[n] == c) for c in set(comp.values())}
    want = [(r[0], int(close[n].sum()), least[comp[n]], r[0] == least[comp[n]]) for n, r in enumerate(ok)] + [(r[0], 0, r[0], True) for r in rows if r not in ok]
    got = [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in cover_tree.near_duplicates(spark, df).collect()]
    assert sorted(got) == sorted(want)
    assert close.sum() > 100 and close[-12:].any()
    assert cover_tree.near_duplicates(spark, df.limit(0)).count() == 0


def test_fingerprints(spark):
    df = documents(spark)
    got = fingerprints.edited_fingerprints(spark, df).collect()
    rows = sorted(((r["doc_id"] if r["doc_id"] is not None else -(1 << 63), r["text"] or "") for r in df.collect()), reverse=True)
    assert len(got) == len(rows)
    want = {}
    for n, (i, text) in enumerate(rows):
        after, cut = rows[(n + 1) % len(rows)][1], len(text) // 3
        want.setdefault(i, set()).add((len(text), hashlib.sha256((text[: len(text) - cut] + after[:cut]).encode()).hexdigest()))
    for r in got:
        i = r["doc_id"] if r["doc_id"] is not None else -(1 << 63)
        assert (r["n_chars"], r["edited_sha256"]) in want[i]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    by = {r["doc_id"]: r for r in got}
    assert by[4]["fingerprint"] == by[12]["fingerprint"] and by[1]["fingerprint"] == ""
    assert by[11]["near_edited"] > 0.25 > by[11]["near_next"]
    assert fingerprints.edited_fingerprints(spark, df.limit(0)).count() == 0
    one = fingerprints.edited_fingerprints(spark, df.where("doc_id = 8")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert set(fingerprints.fingerprint(df).columns) == {*df.columns, "fingerprint"}


def test_syncmers_are_context_free():
    rng = np.random.default_rng(2)
    a, b = rng.integers(97, 123, 400, dtype=np.uint8), rng.integers(97, 123, 300, dtype=np.uint8)
    at, h = fingerprints.syncmers(a)
    again, g = fingerprints.syncmers(np.concatenate([b, a]))
    inside = again >= len(b)
    assert (again[inside] - len(b)).tolist() == at.tolist() and g[inside].tolist() == h.tolist()
    for p in range(len(a) - fingerprints.K + 1):  # by the definition
        order = [fingerprints.inner_order(a[p + i : p + i + fingerprints.S])[0] for i in range(fingerprints.K - fingerprints.S + 1)]
        assert (p in set(at.tolist())) == (min(order) in (order[0], order[-1]))


def test_tokens_equal_the_library_and_packing_round_trips(spark):
    path = packing.default_tokenizer()
    tok = WordTokenizer(path)
    texts = ["", None, "Don't STOP'S it's", "É é É ÀÉ ß SSß ÿ ×÷ a×b", "12 345 a1b2 +1 (743) 555-3824", "hello... world!! (x) a_b", "日本語 テスト", "<|endoftext|> x<|startoftext|>", "x" * 60, "é" * 30, "\x1c a\x1db", "İstanbul ǅ ﬁ", BASE]
    buf, offsets = textvec.raw(pa.array(texts))
    ids, begin = tok.encode(buf, offsets, 0)
    for k, t in enumerate(texts):
        assert ids[begin[k] : begin[k + 1]].tolist() == [*tok.library.encode(t or "", add_special_tokens=False).ids, 0]
    df = documents(spark)
    out = packing.pack_documents(spark, df).collect()
    want = []
    for r in df.collect():
        all_ids = [*tok.library.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for n, s in enumerate(range(0, len(all_ids), 2048)):
            part = all_ids[s : s + 2048]
            want.append((r["doc_id"], n, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out), key=repr) == sorted(want, key=repr)
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(spark, df.limit(0)).count() == 0


def test_sum_of_squares_fills_sequences():
    rng = np.random.default_rng(0)
    lengths = np.sort(np.minimum(2048, rng.geometric(1 / 500, 6000)))[::-1]
    bins, offsets, opened = packing.sum_of_squares(lengths, 2048)
    fill = np.bincount(bins, lengths)
    assert fill.max() <= 2048 and len(fill) == opened
    assert opened <= 1.02 * -(-lengths.sum() // 2048)


def test_span_dedup_against_brute_force(spark):
    passage = "Here begins a passage of some length. It goes on for a second sentence of words. And then a third one ends it all for now."
    extra = [(100 + i, f"Own start number {i} here. {passage} Own end {i} of the text.", "en", "s", 0, "", "") for i in range(4)]
    df = documents(spark, extra)
    rows = sorted(((r["doc_id"] if r["doc_id"] is not None else -(1 << 63), r["text"] or "") for r in df.distinct().collect()))
    seen, spans = {}, {}
    for i, text in rows:
        marks = list(WORD.finditer(text))
        sentences, current = [], []
        for k, m in enumerate(marks):
            current.append(m)
            if m.group()[-1] in ".!?" or k + 1 == len(marks) or "\n" in text[m.end() : marks[k + 1].start()]:
                sentences.append(current)
                current = []
        spans[i, text] = (sentences, [])
        for a in range(len(sentences)):
            for b in range(a + 1, len(sentences)):
                words = sum(map(len, sentences[a : b + 1]))
                if words >= span_dedup.SEVERAL and (b == a + 1 or words - len(sentences[a]) < span_dedup.SEVERAL or words - len(sentences[b]) < span_dedup.SEVERAL):
                    key = tuple(low(m.group()) for s in sentences[a : b + 1] for m in s)
                    spans[i, text][1].append((a, b, key))
                    seen.setdefault(key, []).append((i, text, a))
    got = {(r["doc_id"], r["text"], r["n_removed"]) for r in span_dedup.span_dedup(spark, df).collect()}
    want = set()
    for (i, text), (sentences, mine) in spans.items():
        gone = {s for a, b, k in mine if len(seen[k]) > 1 and seen[k][0] != (i, text, a) for s in range(a, b + 1)}
        kept, at = [], 0
        for n, s in enumerate(sentences):
            if n in gone:
                kept.append(text[at : s[0].start()])
                at = sentences[n + 1][0].start() if n + 1 < len(sentences) else len(text)
        want.add((None if i == -(1 << 63) else i, "".join(kept) + text[at:], len(gone)))
    assert got == want
    assert sum(n for i, _, n in want if i and i >= 101) >= 6 and all(n == 0 for i, _, n in want if i == 100)
    assert len(span_dedup.span_dedup(spark, df).collect()) == df.count()
    assert span_dedup.span_dedup(spark, df.limit(0)).count() == 0


def test_chain_marginals_against_plain_recursion():
    rng = np.random.default_rng(0)
    score, first, steps = rng.normal(-2, 2, 700), np.array([0, 1, 1, 300, 700]), np.array([-1.0, 0.3, 0.8])
    got = toxicity.chain(score, first, steps)[0]
    move = np.exp(np.array([[0, steps[0]], [steps[1], steps[2]]]))
    for a, b in zip(first[:-1], first[1:], strict=True):
        ahead, back, last = np.zeros((b - a, 2)), np.ones((b - a, 2)), np.array([1.0, 0.0])
        for t in range(b - a):
            last = (last @ move) * np.array([1, np.exp(score[a + t])])
            last /= last.sum()
            ahead[t] = last
        for t in range(b - a - 2, -1, -1):
            back[t] = move @ (back[t + 1] * np.array([1, np.exp(score[a + t + 1])]))
            back[t] /= back[t].sum()
        both = ahead * back
        assert np.allclose(both[:, 1] / both.sum(1), got[a:b]) if b > a else True


def test_toxicity_held_out(spark):
    from pyspark.sql import functions as F

    from memloom.llm.common import table

    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels").where("doc_id is not null")
    some = docs.join(labels.where(F.col("toxic").isNotNull()), "doc_id", "left_semi").where("lang = 'en'")
    model = toxicity.learn_from(spark, some, labels)
    scored = toxicity.score_toxicity(some, model).join(labels, "doc_id").where(toxicity.held_out("doc_id")).collect()
    right = sum(r["predicted"] == r["toxic"] for r in scored)
    assert right >= 0.97 * len(scored) and len(scored) > 300
    hits = [r for r in scored if r["predicted"] and r["spans"]]
    assert hits
    texts = {r["doc_id"]: r["text"] for r in some.collect()}
    words = {w for r in hits for s in r["spans"] for w in re.findall(r"\w+", texts[r["doc_id"]][s["start"] : s["stop"]].lower())}
    assert {"idiot", "moron"} & words
    awkward = documents(spark)
    out = toxicity.score_toxicity(awkward, model).collect()
    assert len(out) == awkward.count() and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.score_toxicity(awkward.limit(0), model).count() == 0
    assert set(toxicity.drop_toxic(awkward, model).columns) == set(awkward.columns)


def test_learning_passes_over_long_texts(spark):
    rows = [(i, ("you utter idiot and moron " if i % 2 else "a calm and friendly note ") * (40_000 if i % 5 == 0 else 3)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows] + [(None, 1)], "doc_id long, toxic int")
    model = toxicity.learn_from(spark, docs, labels)
    scored = toxicity.score_toxicity(docs, model).collect()
    assert all(r["predicted"] == r["doc_id"] % 2 for r in scored) and len(scored) == 200
    only_long = docs.where("doc_id % 5 = 0 or doc_id % 2 = 0")
    with pytest.warns(UserWarning, match="label 1"):
        toxicity.learn_from(spark, only_long, labels)
    null_id = spark.createDataFrame([(None, "x")], "doc_id long, text string")
    assert null_id.select(toxicity.held_out("doc_id").alias("h")).first()["h"] is False


def test_learning_without_labels(spark):
    model = toxicity.learn_from(spark, documents(spark), spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r["predicted"] == 0 for r in toxicity.score_toxicity(documents(spark), model).collect())


def test_span_dedup_of_short_runs_and_unpunctuated_passages(spark):
    rng = np.random.default_rng(5)
    own = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 1 << 40, n))
    passage = [own(50) for _ in range(40)]  # no marks inside; where it lies in its sentence differs
    shared = f"{own(9)}. {own(6)}. {own(7)}. {own(2)}."  # 24 words in sentences of which no two suffice
    rows = [(1, f"{shared} First of its kind follows."), (2, f"{shared} Another thing altogether."), (3, "One of few. Words. First."), (4, "One of few. Words. Other.")]
    rows += [(100 + 2 * n + k, f"{own(int(rng.integers(0, 40)))} {p} {own(int(rng.integers(0, 40)))}") for n, p in enumerate(passage) for k in range(2)]
    halves = " ".join(f"h{x}" for x in range(25)) + ". " + " ".join(f"g{x}" for x in range(25))  # no whole sentence inside
    rows += [(300, f"a b c {halves} d e f."), (301, f"k l m {halves} n o p.")]
    rows += [(400, own(3000))]
    got = {r["doc_id"]: r for r in span_dedup.span_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    assert got[1]["text"] == texts[1] and got[400]["text"] == texts[400] and got[400]["n_removed"] == 0
    assert got[2]["text"] == "Another thing altogether." and got[2]["n_removed"] == 4
    assert got[4]["text"] == texts[4]  # too short
    for i in (*range(100, 180, 2), 300):
        assert got[i]["text"] == texts[i]
        assert len(texts[i + 1].split()) - len(got[i + 1]["text"].split()) >= span_dedup.LONG and got[i + 1]["n_removed"] >= 1


def test_spans_are_found_by_both_hashes():
    known, also = np.array([3, 3, 3, 9], np.uint64), np.array([1, 5, 7, 2], np.uint32)
    hit, at = span_dedup._found(known, also, np.array([3, 3, 3, 9, 9, 4], np.uint64), np.array([7, 1, 6, 2, 3, 1], np.uint32))
    assert hit.tolist() == [True, True, False, True, False, False] and at[[0, 1, 3]].tolist() == [2, 0, 3]
    assert span_dedup._found(known[:0], also[:0], known, also)[0].sum() == 0


def test_ranks_of_ties_go_on_over_batches():
    ids, ties = np.array([1, 1, 1, 2, 2, 5, 5, 5, 5]), np.array([3, 3, 8, 1, 1, -4, 0, 0, 9])
    want = [0, 0, 1, 0, 0, 0, 1, 1, 2]
    for cut in range(1, 9):
        head = span_dedup._ranks(ids[:cut], ties[:cut])
        tail = span_dedup._ranks(ids[cut:], ties[cut:], (ids[cut - 1], ties[cut - 1], head[-1]))
        assert [*head, *tail] == want


def test_fingerprints_hold_all_anchors_with_places(spark):
    rng = np.random.default_rng(8)
    own = lambda n: " ".join(f"é{x}" for x in rng.integers(0, 1 << 40, n))
    passage = own(20)
    df = spark.createDataFrame([(1, f"{own(400)} {passage} {own(300)}"), (2, f"{own(100)} {passage} {own(900)}"), (3, "")], "doc_id long, text string")
    texts = {r["doc_id"]: r["text"].encode() for r in df.collect()}
    got = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(spark, df).collect()}
    sets, inside = {}, {}
    for i, text in texts.items():
        at, h = fingerprints.syncmers(np.frombuffer(text, np.uint8))
        assert got[i]["places"] == at.tolist() and got[i]["fingerprint"] == "".join(f"{x:08x}" for x in h.tolist())
        begin = text.find(passage.encode())
        sets[i], inside[i] = set(h.tolist()), [(p - begin, x) for p, x in zip(at.tolist(), h.tolist()) if begin <= p <= begin + len(passage.encode()) - fingerprints.K]
    assert inside[1] == inside[2] and len(inside[1]) > 20
    assert got[2]["near_next"] == pytest.approx(len(sets[1] & sets[2]) / len(sets[1] | sets[2])) and got[2]["near_next"] > 0
    plain = {r["doc_id"]: r for r in fingerprints.fingerprint(df, places_col="places").collect()}
    assert all(plain[i]["places"] == got[i]["places"] and plain[i]["fingerprint"] == got[i]["fingerprint"] for i in texts)


def test_dense_groups_give_a_forest_of_links():
    rng = np.random.default_rng(0)
    v = rng.normal(size=64) / 8 + rng.normal(size=(700, 64)) * 0.026
    v = np.concatenate([v, rng.normal(size=(60, 64))])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    tree, ones = cover_tree.CoverTree(v), np.ones(len(v))
    more, also, links = cover_tree.dual_links(tree, tree, ones, ones, 0.93, True)
    close = v @ v.T >= 0.93
    np.fill_diagonal(close, False)
    assert np.rint(more + also).astype(int).tolist() == close.sum(1).tolist() and close.sum() > 300_000
    assert len(links) < len(v) and all(close[x, y] for x, y in links)
    want = components(range(len(v)), [(int(x), int(y)) for x, y in np.argwhere(np.triu(close))])
    assert components(range(len(v)), links) == want
    half = cover_tree.CoverTree(v[:300]), cover_tree.CoverTree(v[300:])
    left, right, across = cover_tree.dual_links(*half, ones[:300], ones[300:], 0.93, False)
    assert left.tolist() == close[:300, 300:].sum(1).tolist() and right.tolist() == close[:300, 300:].sum(0).tolist()
    assert len(across) < len(v) and all(close[x, 300 + y] for x, y in across)


def test_vectors_of_extreme_sizes_link(spark):
    rows = [(1, [1e200, 2e200, 3e200], 0), (2, [1e200, 2e200, 3e200], 0), (3, [1e-200, 2e-200, 3.0e-200], 0), (4, [5e-324, 1e-323, 1.5e-323], 0), (5, [0.0, -0.0, 0.0], 0), (6, [1e200, float("inf"), 1.0], 0)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in cover_tree.near_duplicates(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (0, 5), 6: (0, 6)}


def test_pieces_of_one_id_are_dealt_into_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 100)
    pieces = spark.createDataFrame([(None, 0, 0, 300, 7)] * 1000, "doc_id long, piece int, start long, length long, ids_crc32 long")
    out = packing.pack(spark, pieces).collect()
    groups = {}
    for r in out:
        groups.setdefault(r["sequence_id"] >> 32, []).append(r)
    assert len(out) == 1000 and len(groups) == 10 and max(map(len, groups.values())) < 200
    assert len({(r["sequence_id"], r["offset"]) for r in out}) == 1000
