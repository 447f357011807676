"""Toxicity: a linear-chain conditional random field tags toxic tokens, and its marginals give scores and spans."""

from __future__ import annotations

import pickle
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memloom.llm import textvec
from memloom.llm.common import table

#: Labelled documents that are learned from, at most so many and with so many bytes of each label, none with more bytes than
#: LEARN_TEXT; buckets of hashed features. Longer labelled texts are scored like any other.
LEARN_EACH, LEARN_BYTES, LEARN_TEXT, BUCKETS = 1_500, 4 << 20, 64 << 10, 1 << 18
#: Byte lengths of the beginnings and endings of a token that are features beside the whole token.
HEADS, TAILS = (3, 4, 5, 6), (4, 5)
ROUNDS, RATE, DECAY, SEGMENT = 40, 0.5, 1e-4, 128
#: Tokens whose marginals are computed at once, but for a longer document's.
AT_ONCE = 200_000
REJECT, FAINT = 0.7, 0.02

_GAP = np.zeros(256, bool)
_GAP[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


@dataclass
class Model:
    """weights: of the hashed features; bias; steps: log potentials O-T, T-O, T-T beside O-O = 0; doc: of a document's score."""

    weights: np.ndarray
    bias: float
    steps: np.ndarray
    doc: np.ndarray


def tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[textvec.Words, np.ndarray, np.ndarray]:
    """Tokens (runs of letters and digits, A-Z lower-cased), the first place of each distinct one, and each token's number among them."""
    offsets = offsets - offsets[0]
    if not len(buf):
        w = textvec.words(buf, offsets)
        return w, np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts, ends = textvec.borders(buf, offsets, ~_GAP[buf])
    w = textvec.hashed(buf, starts, ends, offsets)
    _, at, number = np.unique(w.hashes, return_index=True, return_inverse=True)
    return w, at, number


def features(w: textvec.Words, at: np.ndarray) -> np.ndarray:
    """Feature buckets of the tokens at these places: the token, its beginnings and endings; BUCKETS where it is too short."""
    starts, ends = w.starts[at], w.ends[at]
    size = ends - starts
    cols = [(w.hashes[at] % np.uint64(BUCKETS)).astype(np.int64)]
    for kind, lengths in ((1, HEADS), (2, TAILS)):
        for n in lengths:
            ok = size > n
            code = np.zeros(len(at), np.uint64)
            for i in range(n):
                b = w.buf[np.where(ok, starts + i if kind == 1 else ends - n + i, 0)] if len(w.buf) else code
                b = b.astype(np.uint64)
                code = code * np.uint64(257) + np.where((b >= 65) & (b <= 90), b + np.uint64(32), b)
            code = textvec.mix(code * np.uint64(64) + np.uint64(kind * 16 + n))
            cols.append(np.where(ok, (code % np.uint64(BUCKETS)).astype(np.int64), BUCKETS))
    return np.stack(cols, 1, dtype=np.int32, casting="unsafe")


def chain(score: np.ndarray, first: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over all documents at once. Returns the marginal of T for each token, and the forward and backward
    ratios T : O. A step maps a ratio r to (a r + b) / (c r + d); documents are cut into segments whose maps are composed,
    the ratios at the cuts are carried along each document, and the segments are then filled in side by side."""
    half = int(np.searchsorted(first, len(score) // 2)) if len(score) > AT_ONCE else 0
    if 0 < half < len(first) - 1:  # documents don't depend on each other: less memory at a time
        parts = chain(score[: first[half]], first[: half + 1], steps), chain(score[first[half] :], first[half:] - first[half], steps)
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    n = np.diff(first)
    pieces = -(-n // SEGMENT)
    s = int(pieces.sum())
    if not s:
        none = np.zeros(0)
        return none, none, none
    oo, ot, to, tt = 1.0, *np.exp(steps)
    doc = np.repeat(np.arange(len(n)), pieces)
    nth = np.arange(s) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = first[:-1][doc] + nth * SEGMENT
    length = np.minimum(SEGMENT, n[doc] - nth * SEGMENT)
    psi = np.exp(np.clip(score, -30, 30))
    cell = np.minimum(begin[:, None] + np.arange(SEGMENT), len(score) - 1).T.copy()
    psi, real = psi[cell], (np.arange(SEGMENT)[:, None] < length[None, :])
    whole = real.all(1)

    def composed(order, forward: bool) -> list[np.ndarray]:
        m = [np.ones(s), np.zeros(s), np.zeros(s), np.ones(s)]
        for t in order:
            p = psi[t]
            a, b, c, d = m
            if forward:
                new = [p * (tt * a + ot * c), p * (tt * b + ot * d), to * a + oo * c, to * b + oo * d]
            else:
                new = [tt * p * a + to * c, tt * p * b + to * d, ot * p * a + oo * c, ot * p * b + oo * d]
            scale = 1.0 / (new[2] + new[3])
            m = [x * scale for x in new] if whole[t] else [np.where(real[t], x * scale, y) for x, y in zip(new, m, strict=True)]
        return m

    order_in_doc = np.argsort(nth, kind="stable")
    cuts = np.searchsorted(nth[order_in_doc], np.arange(int(nth.max()) + 2))
    enter, leave = np.zeros(s), np.ones(s)
    if len(cuts) > 2:
        a, b, c, d = composed(range(SEGMENT), True)
        for k in range(len(cuts) - 2):
            here = order_in_doc[cuts[k] : cuts[k + 1]]
            here = here[nth[here] < pieces[doc[here]] - 1]
            enter[here + 1] = (a[here] * enter[here] + b[here]) / (c[here] * enter[here] + d[here])
        a, b, c, d = composed(range(SEGMENT - 1, -1, -1), False)
        for k in range(len(cuts) - 2, 0, -1):
            here = order_in_doc[cuts[k] : cuts[k + 1]]
            leave[here - 1] = (a[here] * leave[here] + b[here]) / (c[here] * leave[here] + d[here])
    ahead, back = np.empty((SEGMENT, s)), np.empty((SEGMENT, s))
    r = enter
    for t in range(SEGMENT):
        r = psi[t] * (ot + tt * r) / (oo + to * r)
        ahead[t] = r
    q = leave
    for t in range(SEGMENT - 1, -1, -1):
        back[t] = q
        u = psi[t] * q
        q = np.where(real[t], (to + tt * u) / (oo + ot * u), q)
    ahead, back = ahead.T[real.T], back.T[real.T]
    both = ahead * back
    return both / (1.0 + both), ahead, back


def _doc_inputs(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """What a document's score is made of: 1, the log odds that some token is toxic, the log of the expected number of them.
    Marginals below FAINT count as 0, so that a text isn't toxic for its length."""
    p = np.where(p < FAINT, 0.0, p)
    total = np.concatenate([[0.0], np.cumsum(np.log1p(-np.minimum(p, 1 - 1e-9)))])
    none = np.minimum(total[first[1:]] - total[first[:-1]], -1e-6)
    some = np.log(-np.expm1(none)) - none
    summed = np.concatenate([[0.0], np.cumsum(p)])
    return np.stack([np.ones(len(none)), np.clip(some, -14, 14), np.log1p(np.maximum(0, summed[first[1:]] - summed[first[:-1]]))], 1)


def _token_labels(feats: np.ndarray, number: np.ndarray, doc: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Labelled tokens from labelled documents: features are chosen one after another, each time the one that explains the
    most toxic documents that none explains yet and hardly any clean one; then those that are as telling and at least a
    quarter as frequent as the chosen ones' median. Tokens of toxic documents that have a chosen feature are toxic."""
    clean_docs, found = np.zeros(BUCKETS + 1, np.int64), []
    for x in range(0, len(toxic), 100):  # few documents at a time: the driver has little memory
        lo, hi = np.searchsorted(doc, [x, x + 100])
        units = np.unique(doc[lo:hi].astype(np.int64) << 32 | number[lo:hi])
        key = np.unique(((units >> 32)[:, None] << 32 | feats[units & 0xFFFFFFFF]).ravel())
        d, f = key >> 32, key & 0xFFFFFFFF
        clean_docs += np.bincount(f[toxic[d] == 0], minlength=BUCKETS + 1)
        keep = (toxic[d] == 1) & (f < BUCKETS)
        found.append(np.stack([d[keep], f[keep]]).astype(np.int32))
    clean_docs = clean_docs[:BUCKETS]
    d, f = np.concatenate(found, 1)
    order = np.argsort(f, kind="stable")
    d, f = d[order], f[order]
    at = np.searchsorted(f, np.arange(BUCKETS + 1))
    open_docs = np.ones(len(toxic), bool)
    gain = np.bincount(f, minlength=BUCKETS).astype(float)
    everywhere = gain.copy()
    enough = max(3.0, 0.002 * toxic.sum())
    chosen = np.zeros(BUCKETS + 1, bool)
    good = clean_docs <= 0.02 * everywhere * max(1, (toxic == 0).sum()) / max(1, (toxic == 1).sum())
    for _ in range(500):
        value = np.where(good & ~chosen[:-1], gain - 10.0 * clean_docs, -1.0)
        best = int(value.argmax())
        if value[best] < enough:
            break
        chosen[best] = True
        new = np.zeros(len(toxic), bool)
        new[d[at[best] : at[best + 1]]] = True
        new &= open_docs
        gain -= np.bincount(f[new[d]], minlength=BUCKETS)
        open_docs &= ~new
    if chosen.any():
        chosen[:-1] |= good & (everywhere - 10.0 * clean_docs >= max(enough, 0.25 * float(np.median(everywhere[chosen[:-1]]))))
    return chosen[feats].any(1)[number] & (toxic[doc] == 1)


def learn(texts: pa.Array, toxic: np.ndarray, base_rate: float) -> Model:
    """Fit the field by gradient steps on the labelled tokens, then the document's score by Newton steps."""
    model = Model(np.zeros(BUCKETS + 1, np.float32), -4.0, np.array([-2.0, 0.0, 0.0]), np.array([np.log(base_rate / (1 - base_rate)), 0.0, 0.0]))
    if not len(toxic) or toxic.min() == toxic.max():
        return model
    buf, offsets = textvec.raw(texts)
    parts = [(tokens(buf[offsets[i] : offsets[j]], offsets[i : j + 1])[0], offsets[i]) for i, j in textvec.slices(buf, offsets)]
    hashes, starts, ends = np.concatenate([w.hashes for w, _ in parts]), np.concatenate([w.starts + o for w, o in parts]), np.concatenate([w.ends + o for w, o in parts])
    w = textvec.Words(buf, starts, ends, np.concatenate([[0], np.cumsum(np.concatenate([w.counts for w, _ in parts]))]), hashes)
    del parts, starts, ends
    _, at, number = np.unique(hashes, return_index=True, return_inverse=True)
    number = number.astype(np.int32)
    feats, doc, first = features(w, at), w.doc(), w.first
    del buf, offsets, at, w, hashes
    y = _token_labels(feats, number, doc, toxic).astype(float)
    weights, squares, bias, bias_sq, steps, steps_sq = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-6), -4.0, 1e-6, model.steps, np.full(3, 1e-6)
    inner = np.ones(len(y), bool)
    inner[first[1:][np.diff(first) > 0] - 1] = False
    left = np.flatnonzero(inner)
    seen = np.array([((1 - y[left]) * y[left + 1]).sum(), (y[left] * (1 - y[left + 1])).sum(), (y[left] * y[left + 1]).sum()])
    for _ in range(ROUNDS):
        score = (weights[feats].sum(1) + bias)[number]
        p, ahead, back = chain(score, first, steps)
        u = np.exp(np.clip(score, -30, 30))[left + 1] * back[left + 1]
        ot, to, tt = np.exp(steps)
        ways = np.stack([ot * u, to * ahead[left], tt * ahead[left] * u])
        slope = seen - (ways / (1.0 + ways.sum(0))).sum(1)
        miss = y - p
        each = np.bincount(number, miss, len(feats))
        g = np.bincount(feats.ravel(), np.repeat(each, feats.shape[1]), BUCKETS + 1) - DECAY * len(toxic) * weights
        squares += g * g
        weights += RATE * g / np.sqrt(squares)
        weights[BUCKETS] = 0.0
        bias_sq += miss.sum() ** 2
        bias += RATE * miss.sum() / np.sqrt(bias_sq)
        steps_sq += slope**2
        steps = np.clip(steps + RATE * slope / np.sqrt(steps_sq), -8, 8)
    model = Model(weights.astype(np.float32), float(bias), steps, model.doc)
    p, _, _ = chain((weights[feats].sum(1) + bias)[number], first, steps)
    x, coef = _doc_inputs(p, first), np.zeros(3)
    for _ in range(25):
        guess = 1 / (1 + np.exp(-(x @ coef)))
        spread = guess * (1 - guess) + 1e-9
        ridge = np.diag([1e-6, 1.0, 1.0])
        coef = coef + np.linalg.solve(x.T @ (x * spread[:, None]) + ridge, x.T @ (toxic - guess) - ridge @ coef)
    share = toxic.mean()  # the sample holds more toxic documents than the whole does
    coef[0] += np.log(base_rate / (1 - base_rate)) - np.log(share / (1 - share))
    model.doc = coef
    return model


def held_out(id_col: str) -> Column:
    """A third of the ids by their checksum; a null id is not held out (and never learned from)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn_from(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", each: int = LEARN_EACH) -> Model:
    """Learn from at most `each` documents of either label, chosen by a hash of the id among rows that aren't held out.

    Texts of more than LEARN_TEXT bytes are passed over, so they don't use up the bytes of the others. Warns if a label has
    rows but none to learn from; without both labels the model gives every text the base rate."""
    rows = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_id is not null and _y in (0, 1)").where(~held_out("_id")).groupBy("_id").agg(F.max("_y").alias("_y"))
    counts = {r["_y"]: r["count"] for r in rows.groupBy("_y").count().collect()}
    total = sum(counts.values())
    base = min(0.99, max(0.01, counts.get(1, 0) / total)) if total else 0.5
    order = F.xxhash64("_id", F.lit("learn"))
    sized = docs.select(F.col(id_col).alias("_id"), F.octet_length(text_col).alias("_size")).where(F.col("_size") <= LEARN_TEXT)
    fit = rows.join(sized, "_id").groupBy("_id", "_y").agg(F.sum("_size").alias("_size"))
    chosen = fit.where("_y = 1").orderBy(order, "_id").limit(each).unionByName(fit.where("_y = 0").orderBy(order, "_id").limit(each))
    summed = F.sum("_size").over(Window.partitionBy("_y").orderBy(order, "_id").rowsBetween(Window.unboundedPreceding, 0))
    chosen = chosen.withColumn("_sum", summed).where(F.col("_sum") <= LEARN_BYTES).select("_id", "_y")
    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")  # at most 2 * each rows
    picked = picked.where(F.octet_length("_text") <= LEARN_TEXT).dropDuplicates(["_id", "_text"])

    def fit_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            sample = pa.Table.from_batches(held).sort_by([("_id", "ascending"), ("_text", "ascending")])
            toxic = sample.column("_y").to_numpy().astype(np.int64)
            fitted = pickle.dumps((learn(sample.column("_text"), toxic, base), set(toxic.tolist())))
            yield pa.RecordBatch.from_arrays([pa.array([fitted], pa.binary())], names=["fitted"])

    # the sample is bounded, so one task fits it; the driver gets the weights alone
    fitted = picked.select("_id", "_text", "_y").repartition(1).mapInArrow(fit_all, "fitted binary").collect()
    model, learned = pickle.loads(fitted[0]["fitted"]) if fitted else (learn(pa.array([], pa.string()), np.zeros(0, np.int64), base), set())
    for y in counts:
        if y not in learned:
            warnings.warn(f"no text to learn label {y} from, of {counts[y]} rows", stacklevel=2)
    return model


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (0 to 1), predicted (1 from REJECT on), spans: toxic runs of tokens (marginal 0.5 or more) as structs of
    start, stop (code points, the end exclusive) and the greatest marginal.

    Null and empty texts get the score of a text without tokens. Ids may be null or repeated: each row is scored by its
    text alone. An empty table gives an empty table; extra columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("marginal", pa.float64())]))
        for batch in batches:
            buf, offsets = textvec.raw(batch.column(1))
            for i, j in textvec.slices(buf, offsets):
                w, p = _marginals(model, buf[offsets[i] : offsets[j]], offsets[i : j + 1])
                z = _doc_inputs(p, w.first) @ model.doc
                likely = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(likely), pa.array((likely >= REJECT).astype(np.int32)), pa.array(_spans(w, p, offsets[i : j + 1] - offsets[i]), span)], names=[id_col, "score", "predicted", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int, spans array<struct<start:long,stop:long,marginal:double>>")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows whose text scores below REJECT, with all their columns; null and empty texts are scored like any other."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = textvec.raw(batch.column(at))
            for i, j in textvec.slices(buf, offsets):
                w, p = _marginals(model, buf[offsets[i] : offsets[j]], offsets[i : j + 1])
                z = _doc_inputs(p, w.first) @ model.doc
                yield batch.slice(i, j - i).filter(pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))) < REJECT))

    return docs.mapInArrow(run, docs.schema)


def _marginals(model: Model, buf: np.ndarray, offsets: np.ndarray) -> tuple[textvec.Words, np.ndarray]:
    w, at, number = tokens(buf, offsets)
    score = (model.weights[features(w, at)].sum(1, dtype=np.float64) + model.bias)[number] if len(at) else np.zeros(0)
    return w, chain(score, w.first, model.steps)[0]


def _spans(w: textvec.Words, p: np.ndarray, offsets: np.ndarray) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in range(len(w.first) - 1)]
    hot = np.flatnonzero(p >= 0.5)
    if len(hot):
        points = np.concatenate([[0], np.cumsum((w.buf & 0xC0) != 0x80)])
        owner = np.searchsorted(w.first, hot, "right") - 1
        for t, d in zip(hot.tolist(), owner.tolist(), strict=True):
            base, spans = points[offsets[d]], out[d]
            start, stop = int(points[w.starts[t]] - base), int(points[w.ends[t]] - base)
            if spans and spans[-1]["token"] == t - 1:
                spans[-1].update(stop=stop, token=t, marginal=max(spans[-1]["marginal"], float(p[t])))
            else:
                spans.append({"start": start, "stop": stop, "marginal": float(p[t]), "token": t})
    return [[{k: s[k] for k in ("start", "stop", "marginal")} for s in spans] for spans in out]


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn_from(spark, docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
