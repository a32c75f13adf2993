"""Byte-level BPE token ids in bulk.

The ids are those of the ``tokenizers`` library for the given file. Most of a corpus is the same words again, so the
text is cut into the tokenizer's pre-tokens by array operations, each distinct piece of a batch is encoded once (a
bounded cache keeps pieces across batches) and ids are gathered by piece. The piece classes (letter, number, space,
other) are asked of the tokenizer itself, character by character. Texts that hold a special token's string or
characters past the basic plane go to the library as they are.
"""

from __future__ import annotations

import json

import numpy as np
import tiktoken
from tokenizers import Tokenizer

from .words import mix

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
CACHE = 200_000
_loaded: dict[str, BulkTokenizer] = {}


def _byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BulkTokenizer:
    def __init__(self, path: str):
        self.plain = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.bpe = tiktoken.Encoding("bulk", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.classes = self._ask_classes()
        rng = np.random.Generator(np.random.PCG64(7))
        self.code = rng.integers(0, 2**64, 0x10000, dtype=np.uint64)
        self.base = np.uint64(0x9E3779B97F4A7C15 | 5)
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _ask_classes(self) -> np.ndarray:
        pre = self.plain.pre_tokenizer.pre_tokenize_str
        out = np.full(0x10000, OTHER, np.uint8)
        for i in range(0x10000):
            if 0xD800 <= i < 0xE000:
                continue
            c = chr(i)
            if len(pre("a" + c)) == 1:
                out[i] = LETTER
            elif len(pre("1" + c)) == 1:
                out[i] = NUMBER
            elif len(pre("?" + c)) != 1:
                out[i] = SPACE
        return out

    def pieces(self, points: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """Starts of the pre-tokens; ``edge`` marks where a text starts."""
        n = len(points)
        kind = self.classes[points]
        new = np.ones(n, bool)
        new[1:] = kind[1:] != kind[:-1]
        new |= edge
        start = new & (kind != SPACE)
        space = kind == SPACE
        last = np.ones(n, bool)  # last of a run of spaces that something else of the same text follows
        last[:-1] = ~space[1:] & ~edge[1:]
        last[-1] = False
        last &= space
        start |= space & new
        start |= last
        blank = last & (points == 0x20)  # joins what follows
        follow = np.flatnonzero(blank) + 1
        start[follow] = False
        # contractions: a lone apostrophe at a piece's start, with the letters that follow
        quote = np.flatnonzero((points == 0x27) & start)
        quote = quote[quote + 1 < n]
        quote = quote[(kind[quote + 1] == LETTER) & ~edge[quote + 1]]
        if len(quote):
            one = points[quote + 1]
            inside = (quote + 2 < n) & ~edge[np.minimum(quote + 2, n - 1)]
            two = np.where(inside, points[np.minimum(quote + 2, n - 1)], 0)
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = np.zeros(len(quote), bool)
            for a, b in ("re", "ve", "ll"):
                long |= (one == ord(a)) & (two == ord(b))
            for k, hit in ((1, short), (2, long & ~short)):
                q = quote[hit]
                start[q + 1] = False
                rest = q + 1 + k
                rest = rest[rest < n]
                start[rest[kind[rest] == LETTER]] = True
        start |= edge
        return np.flatnonzero(start)

    def _encode_new(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        encode = self.bpe.encode_single_piece
        each = [encode(t.encode()) for t in texts]
        size = np.fromiter(map(len, each), np.int64, len(each))
        ids = np.fromiter((i for e in each for i in e), np.int32, int(size.sum()))
        return np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64), size, ids

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text's)."""
        odd = [any(s in t for s in self.special) or max(t, default="") > "￿" for t in texts]
        joined = "".join("" if o else t for t, o in zip(texts, odd, strict=True))
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        lengths = np.array([0 if o else len(t) for t, o in zip(texts, odd, strict=True)], np.int64)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        if len(points):
            edge = np.zeros(len(points), bool)
            edge[offsets[:-1][lengths > 0]] = True
            starts = self.pieces(points, edge)
            ends = np.append(starts[1:], len(points))
            ids, per_piece = self._ids(joined, points, starts, ends)
            total = np.concatenate([[0], np.cumsum(per_piece)])
            out_offsets = total[np.searchsorted(starts, offsets)]
        else:
            ids, out_offsets = np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        if not any(odd):
            return ids, out_offsets
        parts = []
        for i, (t, o) in enumerate(zip(texts, odd, strict=True)):
            parts.append(np.array(self.plain.encode(t, add_special_tokens=False).ids, np.int32) if o else ids[out_offsets[i] : out_offsets[i + 1]])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def _ids(self, joined: str, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = ends - starts
        width = int(n.max())
        h = np.zeros(len(starts), np.uint64)
        code = self.code[points]
        live = np.arange(len(starts))
        for j in range(width):  # pieces are short; those that have ended drop out
            live = live[n[live] > j] if j else live
            h[live] = h[live] * self.base + code[starts[live] + j]
        h = mix(h + n.astype(np.uint64))
        keys, at, inverse = np.unique(h, return_index=True, return_inverse=True)
        where = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = where < len(self.keys)
        known[inside] = self.keys[where[inside]] == keys[inside]
        fresh = np.flatnonzero(~known)
        if len(fresh):
            first, size, ids = self._encode_new([joined[starts[i] : ends[i]] for i in at[fresh]])
            if len(self.keys) + len(fresh) > CACHE:
                kept = known.nonzero()[0]  # start over with what this batch uses
                old = where[kept]
                base = np.concatenate([[0], np.cumsum(self.size[old])])
                gathered = _gather(self.ids, self.first[old], self.size[old])
                self.keys, self.first, self.size, self.ids = keys[kept], base[:-1], self.size[old], gathered
            merged = np.concatenate([self.keys, keys[fresh]])
            order = np.argsort(merged)
            self.first = np.concatenate([self.first, first + len(self.ids)])[order]
            self.size = np.concatenate([self.size, size])[order]
            self.ids = np.concatenate([self.ids, ids])
            self.keys = merged[order]
            where = np.searchsorted(self.keys, keys)
        first, size = self.first[where][inverse], self.size[where][inverse]
        return _gather(self.ids, first, size), size


def _gather(ids: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    total = np.cumsum(size)
    if not len(total):
        return ids[:0]
    return ids[np.arange(total[-1]) - np.repeat(total - size, size) + np.repeat(first, size)]


def tokenizer(path: str) -> BulkTokenizer:
    """One for each file and process."""
    if path not in _loaded:
        _loaded[path] = BulkTokenizer(path)
    return _loaded[path]
