"""Plain Python twins of operators that SQL can't express: every pair, every window, every word, no index and no cluster."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from streamledger.llm import toxicity as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def trained(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 != 1


def fold(text: str | None) -> str:
    return " " + "".join(c if ord(c) > 0xFFFF else T._skeleton(c) for c in text or "" if not 0x300 <= ord(c) <= 0x36F) + " "


def minhash(words) -> int:
    return min((T.hash_word(w) for w in words), default=0)


def weight(terms: dict[str, float], phrases: set[str], folded: str) -> float:
    """Word by word: the heaviest term of a word, unless an exception phrase lies over it."""
    covered = set()
    for p in phrases:
        at = folded.find(f" {p} ")
        while at >= 0:
            covered |= set(range(at, at + len(p) + 1))
            at = folded.find(f" {p} ", at + 1)
    total = 0.0
    for m in re.finditer(r"[^ ]+", folded):
        found = [v for t, v in terms.items() if t == m[0] or (t[0] == "^" and m[0].startswith(t[1:]))]
        if found and m.start() - 1 not in covered:
            total += max(found)
    return total


def density(terms, phrases, folded: str) -> float:
    total = weight(terms, phrases, folded)
    return math.log(total / (len(folded.split()) + T.PADDING)) if total > 0 else -20.0


def toxicity_scores(docs: list[tuple], labels: dict[int, int]) -> list[float]:
    """The score of each (doc_id, text); learned from the labels given."""
    sample = [(fold(t), labels[i]) for i, t in docs if i in labels]
    support = defaultdict(set)
    for f, y in sample:
        words = set(f.split())
        own = words | {"^" + w[:n] for w in words for n in T.STEMS if len(w) > n}
        for term in [None, *own]:
            support[term].add((minhash(words), y))

    def fit(halves) -> dict[str, float]:
        n = lambda term, y: sum(v == y and s % 2 in halves for s, v in support[term])
        toxic, clean, kept = n(None, 1), n(None, 0), {}
        for term in [t for t in support if t]:
            a, b = n(term, 1), n(term, 0)
            if a >= T.SUPPORT:
                w = math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))
                if w >= T.LEAST_WEIGHT:
                    kept[term] = (w, a)
        top = max((a for _, a in kept.values()), default=1)
        return {t: w * math.sqrt(a / top) for t, (w, a) in kept.items()}

    whole, folds = fit((0, 1)), (fit((0,)), fit((1,)))
    pairs = (Counter(), Counter())
    for f, y in sample:
        words = f.split()
        for a, b in zip(words, words[1:], strict=False):
            pairs[y][f"{a} {b}"] += (a in whole) + (b in whole)
    phrases = {p for p, n in pairs[0].items() if n >= 3 and n >= 10 * pairs[1][p]}
    points = sorted((density(folds[1 - minhash(set(f.split())) % 2], phrases, f), y) for f, y in sample)
    points = [p for p in points if p[0] > -19]
    best, cut = -1.0, -5.0
    toxic = sum(y for _, y in points)
    for i, (x, _) in enumerate(points):
        low = points[i - 1][0] if i else x - 0.5
        f1 = 2 * sum(y for _, y in points[i:]) / max(1, len(points) - i + toxic)
        if low < x and f1 > best + 1e-12:
            best, cut = f1, (x + low) / 2
    out = []
    for _, t in docs:
        f = fold(t)
        out.append(1 / (1 + math.exp(-(3.0 * (density(whole, phrases, f) - cut) + math.log(T.THRESHOLD / (1 - T.THRESHOLD))))))
    return out


def components(docs: list[tuple], n: int = 5, percent: int = 80) -> dict:
    """The smallest doc_id that each doc_id reaches, all pairs compared."""
    sets = defaultdict(set)
    for i, t in docs:
        w = [x.translate(_LOWER) for x in WORD.findall(t or "")]
        sets[i].add(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    ids = [i for i in sets if i is not None]
    linked = lambda a, b: any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b])
    near = {a: [b for b in ids if b != a and linked(a, b)] for a in ids}
    out = {}
    for a in ids:
        seen, stack = {a}, [a]
        while stack:
            for b in near[stack.pop()]:
                if b not in seen:
                    seen.add(b)
                    stack.append(b)
        out[a] = min(seen)
    return out


_LOWER = {c: c + 32 for c in range(65, 91)}


def without_repeats(docs: list[tuple], n: int = 13) -> list[tuple[int, str, int, int]]:
    """(doc_id, kept text, words, words removed) of (doc_id, text) with distinct ids."""
    first: dict = {}
    words = {i: WORD.findall(t or "") for i, t in docs}
    for i in sorted(words):
        for k in range(len(words[i]) - n + 1):
            first.setdefault(tuple(words[i][k : k + n]), i)
    out = []
    for i, t in docs:
        gone = set()
        for k in range(len(words[i]) - n + 1):
            if first[tuple(words[i][k : k + n])] < i:
                gone |= set(range(k, k + n))
        out.append((i, " ".join(w for k, w in enumerate(words[i]) if k not in gone), len(words[i]), len(gone)))
    return out


def targets(sizes: dict, weights: dict) -> dict:
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = {s: weights[s] for s in sizes if s not in fixed}
        share = {s: (total - sum(fixed.values())) * w / sum(free.values()) for s, w in free.items()}
        over = {s: 2 * sizes[s] for s in share if share[s] > 2 * sizes[s]}
        if not over:
            return fixed | share
        fixed |= over


def mixed(rows: list[tuple]) -> list[int]:
    """How often the mix takes each (source, size, hash): whole passes, then the smallest hashes, then single fits."""
    sizes = defaultdict(int)
    for s, n, _ in rows:
        sizes[s] += n
    order = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    goal = targets({s: sizes[s] for s in order}, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)})
    once, passes = set(), {}
    for s in order:
        gives = min(2 * sizes[s], round(goal[s]))
        passes[s] = gives // sizes[s] if sizes[s] else 0
        left = gives - passes[s] * sizes[s]
        by_hash = defaultdict(int)
        for t, n, h in rows:
            if t == s:
                by_hash[h] += n
        waiting = sorted(by_hash)
        while waiting and left and by_hash[waiting[0]] <= left:
            left -= by_hash[waiting[0]]
            once.add((s, waiting.pop(0)))
        for _ in range(3):
            classes = {}
            for h in waiting:
                if 0 < by_hash[h] <= left and (s, h) not in once:
                    classes.setdefault(by_hash[h].bit_length(), h)
            for c in sorted(classes, reverse=True):
                if by_hash[classes[c]] <= left:
                    left -= by_hash[classes[c]]
                    once.add((s, classes[c]))
    return [passes[s] + ((s, h) in once) if n else 0 for s, n, h in rows]


def pieces(ids: list[int], capacity: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32 of the ids)."""
    first = len(ids) % capacity or capacity if len(ids) > capacity else len(ids)
    cut = [0, *range(first, len(ids), capacity), len(ids)]
    return [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False))]


def best_fit(lengths: list[int], capacity: int) -> list[int]:
    """Fill of each bin, every bin tried for every piece."""
    fills: list[int] = []
    for n in sorted(lengths, reverse=True):
        fit = [b for b, f in enumerate(fills) if f + n <= capacity]
        if fit:
            fills[max(fit, key=lambda b: fills[b])] += n
        else:
            fills.append(n)
    return fills


def fewest_bins(lengths: list[int], capacity: int) -> int:
    """By trying every placement."""
    best = len(lengths)

    def place(i: int, fills: list[int]) -> None:
        nonlocal best
        if len(fills) >= best:
            return
        if i == len(lengths):
            best = len(fills)
            return
        for b in range(len(fills)):
            if fills[b] + lengths[i] <= capacity and fills[b] not in fills[:b]:
                place(i + 1, [*fills[:b], fills[b] + lengths[i], *fills[b + 1 :]])
        place(i + 1, [*fills, lengths[i]])

    place(0, [])
    return best
