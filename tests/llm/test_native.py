"""Sharding and fingerprints."""

from __future__ import annotations

import hashlib
import re
import struct

import xxhash
from pyspark.sql import functions as F

from streamledger.llm import fingerprints as P
from streamledger.llm.sharding import extendible_shards

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_sketch(text):
    h = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in WORD.findall(text or "")]
    out = set()
    for i in range(len(h) - 4):
        seed = 42
        for x in h[i : i + 5]:
            seed = xxhash.xxh64_intdigest(struct.pack("<Q", x), seed=seed)
        out.add(seed >> 2)
    if 0 < len(h) < 5:
        signed = [str(x - 2**64 if x >= 2**63 else x) for x in h]
        out.add(xxhash.xxh64_intdigest(",".join(signed).encode(), seed=42) >> 2)
    return {x for x in out if x < 2**62 // P.SCALE} or ({min(out)} if out else set())


def test_fingerprints(spark, docs, texts, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    order = sorted((i, t or "") for i, t in texts)
    got = {r["doc_id"]: r for r in P.op7_fingerprints(spark, str(tmp_path)).collect()}
    assert len(got) == len(order)
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for n, (i, t) in enumerate(order):
        after = order[(n + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == ".".join(f"{x:x}" for x in sorted(brute_sketch(t)))
        assert abs(r["near_edited"] - like(brute_sketch(t), brute_sketch(edited))) < 1e-12
        assert abs(r["near_next"] - like(brute_sketch(t), brute_sketch(after))) < 1e-12


def test_sketches_merge(spark):
    rows = spark.createDataFrame([("a b c d e f g h", "x y z u v w q r s"), ("a b", "c"), ("", "a b c d e f"), (None, None)], "a string, b string")
    both = rows.select(P.merge(P.sketch(F.col("a")), P.sketch(F.col("b"))).alias("m"), "a", "b").collect()
    for r in both:
        union = brute_sketch(r["a"]) | brute_sketch(r["b"])
        low = {x for x in union if x < 2**62 // P.SCALE}
        assert set(r["m"]) == (low or ({min(union)} if union else set()))


def test_containment(spark):
    text = " ".join(f"v{i}" for i in range(4000))
    part = " ".join(f"v{i}" for i in range(1000, 1400))
    r = spark.createDataFrame([(part, text)], "a string, b string").select(P.containment(P.sketch(F.col("a")), P.sketch(F.col("b"))).alias("c"), P.containment(P.sketch(F.col("b")), P.sketch(F.col("a"))).alias("d")).first()
    assert r["c"] == 1.0 and 0.05 < r["d"] < 0.16


def test_empty_and_single(spark, empty):
    assert P.with_next(empty).count() == 0
    one = P.with_next(spark.createDataFrame([(5, "abc")], "doc_id long, text string")).first()
    assert (one["text"], one["next_text"]) == ("abc", "abc")


def test_sharding(docs, texts):
    limit = 4000
    rows = extendible_shards(docs, limit).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(i for i, _ in texts)
    bits = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16)
    size = {i: len((t or "").encode()) for i, t in texts}
    shards = {}
    for r in rows:
        shards.setdefault(r["shard"], []).append(r)
        assert r["prefix"] == (bits(r["doc_id"]) >> (60 - r["depth"]))
    for members in shards.values():
        total = sum(r["bytes"] for r in members)
        assert total <= limit or len(members) == 1
        d = members[0]["depth"]
        if d and members[0]["part"] == 0 and total <= limit:  # no shard is deeper than it has to be
            parent = [i for i in size if bits(i) >> (60 - d + 1) == members[0]["prefix"] >> 1]
            assert sum(size[i] for i in parent) > limit


def test_sharding_of_one_key(spark):
    rows = spark.createDataFrame([(7, "x" * 100)] * 50 + [(None, None)], "doc_id long, text string")
    got = extendible_shards(rows, 250).collect()
    by = {}
    for r in got:
        by[r["shard"]] = by.get(r["shard"], 0) + r["bytes"]
    assert len(got) == 51 and max(by.values()) <= 250


def test_sharding_empty(empty):
    assert extendible_shards(empty, 100).collect() == []


def test_sharding_deals_a_hot_key_in_slices(spark):
    """A third of all rows share a key: parts fill in order of size, whatever slices the rows lie in."""
    rows = spark.createDataFrame([(7, "x" * (1 + i % 30)) for i in range(300)] + [(100 + i, "y" * 10) for i in range(600)], "doc_id long, text string").repartition(5)
    got = [r for r in extendible_shards(rows, 90).collect() if r["doc_id"] == 7]
    parts = {}
    for r in got:
        parts.setdefault(r["part"], []).append(r["bytes"])
    assert len(got) == 300 and sorted(parts) == list(range(100)) and all(len(p) == 3 and sum(p) <= 90 for p in parts.values())
    assert [b for p in sorted(parts) for b in sorted(parts[p], reverse=True)] == sorted((r["bytes"] for r in got), reverse=True)


def _next_texts(rows):
    return sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"], r["next_text"]) for r in rows)


def test_next_over_two_levels_of_ranges(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(P, "RANGES", 4)
    order = sorted((i, t or "") for i, t in texts)
    want = sorted((True, i, t, order[(n + 1) % len(order)][1]) for n, (i, t) in enumerate(order))
    assert _next_texts(P.with_next(docs, target=200).collect()) == want


def test_next_where_a_third_has_no_id(spark, monkeypatch):
    """Rows without id fill ranges of their own; each row is the next of exactly one, and ids follow in order."""
    monkeypatch.setattr(P, "RANGES", 4)
    rows = [(None, f"n{i % 40}") for i in range(200)] + [(None, None)] * 10 + [(i, f"t{i}") for i in range(300)]
    got = P.with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), target=300).collect()
    assert sorted(r["next_text"] for r in got) == sorted(t or "" for _, t in rows) == sorted(r["text"] for r in got)
    assert {r["doc_id"]: r["next_text"] for r in got if r["doc_id"] is not None and r["doc_id"] < 299} == {i: f"t{i + 1}" for i in range(299)}
    assert sum(r["doc_id"] is None and r["next_text"] == "t0" for r in got) == 1
