"""Vectorised word splitting and hashing over UTF-8 bytes.

A word is a run of ``[^\\x20\\x09-\\x0D]``. The separators are single bytes in UTF-8, so the split runs on
bytes. Words get a 64-bit polynomial hash over a table of random byte values, then a bijective mixer;
windows of words get a second (Rabin-Karp) polynomial over the word hashes. Two different sequences share
a hash with probability near 2**-60.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RANGE = 1 << 18  # bytes of the documents that are worked on at a time
SEPARATORS = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
_IS_SEP = np.zeros(256, bool)
_IS_SEP[list(SEPARATORS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 5
_INV = pow(_BASE, -1, 2**64)
_WINDOW = np.uint64(0xD1342543DE82EF95)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, ``n`` at least. Those for a range of documents are kept, those for a longer text are not."""
    if len(_powers[0]) >= n:
        return _powers
    size = max(RANGE + 1, n)
    tables = []
    for base in (_BASE, _INV):
        table = np.full(size, base, np.uint64)
        table[0] = 1
        tables.append(np.multiply.accumulate(table))
    if size == RANGE + 1:
        _powers[:] = tables
    return tables


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def batches(offsets: np.ndarray, limit: int = RANGE):
    """Ranges of documents of about ``limit`` bytes; a longer document makes a range of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each document the index of its first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    keep = ~_IS_SEP[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    edge[0] = edge[-1] = True
    before, after = np.empty_like(keep), np.empty_like(keep)
    before[0], before[1:] = False, keep[:-1]
    after[-1], after[:-1] = False, keep[1:]
    starts = np.flatnonzero(keep & (~before | edge[:-1]))
    ends = np.flatnonzero(keep & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    power, inverse = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def roll(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on, whatever document they belong to."""
    n = max(len(h) - k + 1, 0)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _WINDOW + h[j : j + n]
    return mix(out + np.uint64(k))


def window_index(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions of windows that stay in their document, offsets of each document's windows)."""
    count = np.maximum(np.diff(first) - k + 1, 0)
    offsets = np.concatenate([[0], np.cumsum(count)])
    index = np.arange(offsets[-1]) - np.repeat(offsets[:-1], count) + np.repeat(first[:-1], count)
    return index, offsets


def documents_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False):
    """For each range of documents: (a, b, first word of each document, hashes of the words, bytes, starts, ends)."""
    for a, b in batches(offsets):
        part = data[offsets[a] : offsets[b]]
        part = lower_ascii(part) if lower else part
        starts, ends, first = word_spans(part, offsets[a : b + 1] - offsets[a])
        yield a, b, first, word_hashes(part, starts, ends), part, starts, ends


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int, lower: bool = True) -> list[np.ndarray]:
    """Each document's sorted distinct k-word shingle hashes; with fewer words the whole sequence is one shingle."""
    out: list[np.ndarray] = []
    for a, b, first, h, *_ in documents_words(data, offsets, lower):
        rolled = roll(h, k)
        for i in range(b - a):
            x, y = first[i], first[i + 1]
            if y - x >= k:
                out.append(np.unique(rolled[x : y - k + 1]))
            elif y > x:
                out.append(roll(h[x:y], int(y - x)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out
