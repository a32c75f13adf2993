"""N-gram Jaccard join, substring dedup and components against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import functions as F

from streamledger.llm.components import components
from streamledger.llm.exchange import pack, unpack
from streamledger.llm.jaccard_join import jaccard_components
from streamledger.llm.substring_dedup import remove_repeated_windows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def shingles(text, k=5):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    u = Union()
    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                u.join(i, j)
    return {i: (len(a), u.find(i)) for i, a in sets}


def test_jaccard_components(docs, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(docs).collect()}
    assert got == brute_components(texts)


def test_jaccard_ties_at_the_threshold(spark):
    w = [f"x{i}" for i in range(300)]
    rows = [(1, " ".join(w[:49])), (2, " ".join(w[:45])), (3, " ".join(w[:40])), (4, " ".join(w[:36])), (5, " ".join(w[4:49]))]  # 45, 41, 36, 32, 41 shingles
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_jaccard_null_ids_and_repeated_rows(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (9, "a b c d e f")]
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == [(3, 3), (3, 3), (9, 3), (None, None)]


def test_empty_tables(empty):
    assert jaccard_components(empty).collect() == []
    assert remove_repeated_windows(empty).collect() == []


def brute_removed(rows, k=13):
    first, words = {}, {}
    for i, t in rows:
        w = words[i] = WORD.findall(t or "")
        for j in range(len(w) - k + 1):
            key = tuple(w[j : j + k])
            first[key] = min(i, first.get(key, i))
    out = {}
    for i, w in words.items():
        cut = set()
        for j in range(len(w) - k + 1):
            if first[tuple(w[j : j + k])] < i:
                cut |= set(range(j, j + k))
        out[i] = (len(w), len(cut), " ".join(x for j, x in enumerate(w) if j not in cut), cut)
    return out


def test_substring_dedup(docs, texts):
    want = brute_removed(texts)
    for r in remove_repeated_windows(docs).collect():
        n, removed, kept, cut = want[r["doc_id"]]
        assert (r["n_words"], r["n_removed"], r["kept_text"]) == (n, removed, kept)
        assert {j for s in r["spans"] for j in range(s["start"], s["stop"])} == cut
        assert all(a["stop"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:], strict=False))


def test_substring_rows_of_one_id_never_cut_each_other(spark):
    t = " ".join(f"v{i}" for i in range(20))
    rows = spark.createDataFrame([(1, t), (1, t), (2, t), (None, t)], "doc_id long, text string")
    assert sorted(((r["doc_id"], r["n_removed"]) for r in remove_repeated_windows(rows).collect()), key=str) == [(1, 0), (1, 0), (2, 20), (None, 20)]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(50)] + [(None, 4), (5, 5)]
    u = Union()
    for a, b in edges:
        if a is not None and a != b:
            u.join(a, b)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: u.find(x) for x in u.up}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pack_round_trip():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**64, 1000, dtype=np.uint64))
    values = rng.integers(-(2**63), 2**63 - 1, len(keys))
    a, b = unpack(pack(keys, values))
    assert (a == keys).all() and (b.view(np.int64) == values).all()
    assert [len(x) for x in unpack(pack(keys[:0], values[:0]))] == [0, 0]


def test_copies_do_not_multiply(spark):
    t = " ".join(f"v{i}" for i in range(40))
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(t).alias("text"))
    assert jaccard_components(rows).select("component_id").distinct().collect() == [(0,)]
