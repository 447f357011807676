"""Words of whole batches of texts as numpy arrays: no Python code runs per word.

A batch's UTF-8 bytes lie in one buffer, so white space, word borders and 64-bit word hashes come from a
handful of array operations. The separators are the six ASCII spaces, which never occur inside a
multi-byte character, so working on bytes is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Which bytes words are made of: all but the six spaces.
INK = ~_SPACE
#: Which bytes terms are made of: digits, ASCII letters and all of non-ASCII characters.
TERM_INK = np.zeros(256, bool)
TERM_INK[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_rng = np.random.Generator(np.random.PCG64(20240201))
_BYTE_KEYS = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED_KEYS = _BYTE_KEYS[_FOLD]
_pow = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow["up"]) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _pow[name] = np.cumprod(steps)
    return _pow["up"], _pow["down"]


@dataclass
class Words:
    """buf: bytes; starts, ends: of each word; first: the index of each document's first word, and one past the last; hashes: of each word."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts, and where each begins (and the last ends); a null text has none."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return buf, offsets - (offsets[0] if len(offsets) else 0)


def slices(buf: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about SLICE_BYTES each; a longer document is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, "right")) - 1)
        yield i, min(j, n)
        i = j


def borders(buf: np.ndarray, offsets: np.ndarray, ink: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of ink begin and end; no run crosses documents."""
    n = len(buf)
    before = np.empty(n, bool)
    before[0], before[1:] = False, ink[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, ink[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    return np.flatnonzero(ink & ~before), np.flatnonzero(ink & ~after) + 1


def hashed(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, offsets: np.ndarray, fold: bool = True) -> Words:
    n = len(buf)
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((_FOLDED_KEYS if fold else _BYTE_KEYS)[buf] * up[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts] ^ (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return Words(buf, starts, ends, np.searchsorted(starts, offsets), hashes)


def words(buf: np.ndarray, offsets: np.ndarray, fold: bool = True, ink: np.ndarray = INK) -> Words:
    """fold: A-Z count as a-z in the hashes. ink: the bytes that words are made of."""
    offsets = offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)
    if not len(buf):
        none = np.zeros(0, np.int64)
        return Words(buf, none, none, np.zeros(len(offsets), np.int64), np.zeros(0, np.uint64))
    starts, ends = borders(buf, offsets, ink[buf])
    return hashed(buf, starts, ends, offsets, fold)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's runs of k words (of all its words where it has fewer), and where each document's begin."""
    seeds = mix(np.arange(1, k + 1, dtype=np.uint64) * _BASE) | np.uint64(1)
    n, counts = len(w.hashes), w.counts
    out = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k):
        out += w.hashes[j : j + len(out)] * seeds[j]
    out = mix(out)
    each = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(each)])
    at = np.repeat(w.first[:-1] - first[:-1], each) + np.arange(first[-1])
    short = np.flatnonzero((counts > 0) & (counts < k))
    got = out[np.minimum(at, max(len(out) - 1, 0))] if len(out) else np.zeros(len(at), np.uint64)
    for d in short:
        h = w.hashes[w.first[d] : w.first[d + 1]]
        got[first[d]] = mix((h * seeds[: len(h)]).sum(dtype=np.uint64, keepdims=True) ^ np.uint64(len(h)))[0]
    return got, first


def sorted_sets(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct values in rising order, and where each document's begin."""
    if not len(values):
        return values, np.zeros_like(first)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    parts = values.copy()
    for i, j in zip(first[:-1], first[1:], strict=True):
        parts[i:j].sort()
    new = np.ones(len(parts), bool)
    new[1:] = (parts[1:] != parts[:-1]) | (doc[1:] != doc[:-1])
    return parts[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(first) - 1))])
