"""Ids of whole batches of texts, as the tokenizers library gives them, with each distinct word encoded once.

Texts fall apart at ASCII white space; no pre-token of the word-end BPE files crosses it, so the ids of a text are the ids
of its words one after another. Runs of ASCII or Latin-1 letters, digits and ASCII marks are merged here for thousands of
them at once; all other words, and all tokenizers of another kind, go through the library.
"""

from __future__ import annotations

import json
import os

import numpy as np
import xxhash

from memloom.llm import textvec

#: Words that one worker remembers before it starts anew, and the longest word (in bytes) that is merged here.
REMEMBERED, LONGEST = 600_000, 48
_NONE = np.int32(1 << 30)
_BLANK, _LETTER, _DIGIT, _MARK, _OTHER = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[0x21:0x7F] = _MARK
_KIND[[0x20, *range(0x09, 0x0E)]] = _BLANK
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_KIND[0x30:0x3A] = _DIGIT
_KIND[0x27] = _OTHER


def _byte_chars() -> dict[int, str]:
    """The printable stand-in for each byte that byte-level vocabularies use: printable Latin-1 as itself, the rest from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class WordTokenizer:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.fast, self.kind = self._known(spec), _KIND.copy()
        if self.fast:
            self._tables(spec)
        self._reset()

    @staticmethod
    def _known(spec: dict) -> bool:
        model, pre, norm = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
        kinds = [x["type"] for x in norm.get("normalizers", [])], [x["type"] for x in pre.get("pretokenizers", [])]
        return model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout") and kinds == (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"])

    def _tables(self, spec: dict) -> None:
        model = spec["model"]
        vocab, chars = model["vocab"], _byte_chars()
        for token in spec.get("added_tokens", []):
            self.kind[token["content"].encode()[0]] = _OTHER
        self.inner = np.array([vocab[chars[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[chars[b] + "</w>"] for b in range(256)], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.uint32)
        right = np.array([vocab[b] for _, b in pairs], np.uint32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.size = np.uint32(max(vocab.values()) + 1)
        keys = left * self.size + right
        self.bits = 20
        self.slots = np.full((1 << self.bits) + 64, 0xFFFFFFFF, np.uint32)
        self.ranks = np.full(len(self.slots), _NONE, np.int32)
        self.probes = 1
        for rank, (key, at) in enumerate(zip(keys.tolist(), self._at(keys).tolist(), strict=True)):
            step = 0
            while self.slots[at + step] != 0xFFFFFFFF:
                step += 1
            self.slots[at + step], self.ranks[at + step] = key, rank
            self.probes = max(self.probes, step + 1)

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(2654435769)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.uint32) * self.size + b.astype(np.uint32)
        at = self._at(keys)
        out = np.where(self.slots[at] == keys, self.ranks[at], _NONE)
        for step in range(1, self.probes):
            more = np.flatnonzero((out == _NONE) & (self.slots[at + step - 1] != 0xFFFFFFFF))
            if not len(more):
                break
            hit = self.slots[at[more] + step] == keys[more]
            out[more[hit]] = self.ranks[at[more[hit]] + step]
        return np.where((a < 0) | (b < 0), _NONE, out)

    def _merge(self, ids: np.ndarray) -> np.ndarray:
        """Rows of ids, -1 behind each row's last: merges the leftmost pair of least rank in every row until none is left."""
        done = ids.copy()
        rows = np.arange(len(ids))
        ranks = self._rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        while len(rows):
            j = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), j]
            go = best < _NONE
            if not go.all():
                done[rows[~go]] = ids[~go]
                rows, ids, ranks, j, best = rows[go], ids[go], ranks[go], j[go], best[go]
                if not len(rows):
                    break
            n, width = ids.shape
            all_rows, cols = np.arange(n), np.arange(width)[None, :]
            ids[all_rows, j] = self.merged[best]
            take = np.minimum(cols + (cols > j[:, None]), width - 1)
            ids = np.take_along_axis(ids, take, 1)
            ids[:, -1] = -1
            ranks = np.take_along_axis(ranks, np.minimum(take[:, :-1], width - 2), 1)
            ranks[:, -1] = _NONE
            right = np.where(j + 1 < width, ids[all_rows, np.minimum(j + 1, width - 1)], -1)
            at_right = np.minimum(j, width - 2)
            ranks[all_rows, at_right] = np.where(j < width - 1, self._rank(ids[all_rows, j], right), ranks[all_rows, at_right])
            k = np.flatnonzero(j > 0)
            if len(k):
                ranks[k, j[k] - 1] = self._rank(ids[k, j[k] - 1], ids[k, j[k]])
        return done

    def _reset(self) -> None:
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 20, np.int32), 0
        self.offset, self.length, self.stored = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64), 0

    def _store(self, lengths: np.ndarray, ids: np.ndarray) -> None:
        n, at = len(lengths), self.stored
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while at + n > len(self.offset):
            self.offset, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.offset, self.length))
        self.flat[self.used : self.used + len(ids)] = ids
        self.offset[at : at + n] = self.used + np.cumsum(lengths) - lengths
        self.length[at : at + n] = lengths
        self.used += len(ids)
        self.stored += n

    def _units(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[textvec.Words, np.ndarray]:
        """Pre-tokens: runs of letters, single digits, runs of marks; a chunk between spaces with any other byte (an
        apostrophe, a letter beyond Latin-1) is one unit as a whole. Also whether each unit is plain."""
        kind = self.kind[buf]
        lead = np.flatnonzero(buf == 0xC3)
        lead = lead[lead + 1 < len(buf)]
        after = buf[lead + 1]
        lead = lead[(after != 0x97) & (after != 0xB7)]
        kind[lead] = kind[lead + 1] = _LETTER
        chunks = textvec.borders(buf, offsets, kind != _BLANK)
        if not self.fast:
            kind[kind != _BLANK] = _OTHER
        odd = np.add.reduceat(kind == _OTHER, chunks[0]) > 0 if len(chunks[0]) else np.zeros(0, bool)
        cut = np.zeros(len(buf) + 1, bool)
        cut[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        for x, y in zip(chunks[0][odd].tolist(), chunks[1][odd].tolist(), strict=True):
            cut[x:y] = False
            kind[x:y] = _OTHER
        cut[chunks[0]] = True
        starts = np.flatnonzero(cut[:-1] & (kind != _BLANK))
        cut[chunks[1]] = True
        every = np.flatnonzero(cut)
        ends = every[np.searchsorted(every, starts) + 1]
        units, plain = textvec.hashed(buf, starts, ends, offsets), kind[starts] != _OTHER
        for i in np.flatnonzero(~plain).tolist():  # in these, case may matter
            units.hashes[i] = xxhash.xxh64_intdigest(buf[starts[i] : ends[i]].tobytes())
        return units, plain

    def _learn(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, plain: np.ndarray) -> np.ndarray:
        """Encode distinct units and store them; returns their rows."""
        out = np.zeros(len(starts), np.int64)
        size = ends - starts
        slow = ~plain | (size > LONGEST)
        for low, width in ((0, 4), (4, 8), (8, 12), (12, 16), (16, 24), (24, LONGEST)):
            rows = np.flatnonzero(~slow & (size > low) & (size <= width))
            for block in np.array_split(rows, len(rows) // 8192 + 1):
                if not len(block):
                    continue
                inside = np.arange(width) < size[block][:, None]
                b = buf[np.minimum(starts[block][:, None] + np.arange(width), len(buf) - 1)]
                b = b + np.uint8(32) * ((b >= 65) & (b <= 90))
                b[:, 1:] += np.uint8(32) * ((b[:, :-1] == 0xC3) & (b[:, 1:] >= 0x80) & (b[:, 1:] <= 0x9E))
                ids = np.where(inside, self.inner[b], np.int32(-1))
                r, end = np.arange(len(block)), size[block] - 1
                ids[r, end] = self.last[b[r, end]]
                ids = self._merge(ids)
                real = ids >= 0
                out[block] = self.stored + r
                self._store(real.sum(1), ids[real])
        rest = np.flatnonzero(slow)
        if len(rest):
            found = [e.ids for e in self.library.encode_batch_fast([buf[starts[i] : ends[i]].tobytes().decode() for i in rest.tolist()], add_special_tokens=False)]
            out[rest] = self.stored + np.arange(len(rest))
            self._store(np.array([len(x) for x in found], np.int64), np.array([i for x in found for i in x], np.int32))
        return out

    def encode(self, buf: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each text's closed by end_id, and where each text's begin."""
        offsets = offsets - offsets[0]
        if len(self.keys) > REMEMBERED:
            self._reset()
        if len(buf):
            w, plain = self._units(buf, offsets)
            distinct, at, inverse = np.unique(w.hashes, return_index=True, return_inverse=True)
            place = np.searchsorted(self.keys, distinct)
            new = np.ones(len(distinct), bool)
            inside = place < len(self.keys)
            new[inside] = self.keys[place[inside]] != distinct[inside]
            if new.any():
                rows = self._learn(w.buf, w.starts[at[new]], w.ends[at[new]], plain[at[new]])
                self.keys, self.rows = np.insert(self.keys, place[new], distinct[new]), np.insert(self.rows, place[new], rows)
            slot = self.rows[np.searchsorted(self.keys, distinct)][inverse]
            length = self.length[slot]
            first = np.concatenate([[0], np.cumsum(length)])
            ids = self.flat[np.repeat(self.offset[slot] - first[:-1], length) + np.arange(first[-1])]
            begin = first[w.first] + np.arange(len(w.first))
        else:
            ids, begin = np.zeros(0, np.int32), np.arange(len(offsets))
        out = np.full(begin[-1], end_id, np.int32)
        body = np.ones(len(out), bool)
        body[begin[1:] - 1] = False
        out[body] = ids
        return out, begin
