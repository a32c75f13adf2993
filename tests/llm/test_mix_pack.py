"""Mixing, packing, tokens, embeddings and the pipeline."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from streamledger.llm import embedding_dedup, mixing, packing
from streamledger.llm.tokens import tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def test_tokens_equal_the_library(plain, texts):
    rng = random.Random(8)
    letters = [*"abz'  \n\t\r!?.12sStrevemld é中　́ñ²½_-  ", "'s", "'re", "'ll", "  ", "\n\n", "<|endoftext|>", "😀"]
    some = ["".join(rng.choice(letters) for _ in range(rng.randrange(14))) for _ in range(4000)] + [t or "" for _, t in texts]
    ids, offsets = tokenizer(PATH).batch(some)
    for i, e in enumerate(plain.encode_batch(some, add_special_tokens=False)):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == e.ids, some[i]


def test_token_cache_starts_over(plain, monkeypatch):
    monkeypatch.setattr("streamledger.llm.tokens.CACHE", 50)
    t = tokenizer(PATH)
    t.forget()
    for k in range(6):
        some = [f"word{k}{i} and the{i % 3}" for i in range(40)]
        ids, offsets = t.batch(some)
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [e.ids for e in plain.encode_batch(some, add_special_tokens=False)]
    t.forget()


def test_pack(docs, texts, plain):
    rows = packing.pack(docs, PATH, 128, 2, part=60).collect()
    ids = {i: [*plain.encode(t or "", add_special_tokens=False).ids, 2] for i, t in texts}
    pieces, bins = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(ids)
    for i, own in pieces.items():
        own.sort(key=lambda r: r["piece"])
        at = 0
        for k, r in enumerate(own):
            assert (r["piece"], r["start"]) == (k, at) and (k == 0 or r["length"] == 128)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[i][at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids[i]) and (len(own) == 1 or at > 128)
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [0, *np.cumsum([n for _, n in b])[:-1]] and sum(n for _, n in b) <= 128
    bound = packing.lower_bound(np.bincount([r["length"] for r in rows], minlength=129), 128)
    assert bound <= len(bins) <= bound + 2


def test_lower_bound_holds():
    rng = random.Random(4)
    for _ in range(60):
        lengths = np.array([rng.randrange(1, 21) for _ in range(rng.randrange(1, 40))])
        bins, offsets, left = packing.best_fit_decreasing(lengths, 20)
        assert packing.lower_bound(np.bincount(lengths, minlength=21), 20) <= len(left)
        assert all(lengths[bins == b].sum() == 20 - left[b] for b in range(len(left)))
    assert packing.lower_bound(np.bincount([11] * 6 + [9] * 2, minlength=21), 20) == 6


def test_pack_repeated_and_empty(spark, empty):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "doc_id long, text string")
    got = packing.pack(rows, PATH).collect()
    assert len(got) == 3 and len({r["sequence_id"] for r in got}) == 1
    assert packing.pack(empty, PATH).count() == 0


def brute_targets(sizes, weights):
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = {s: weights[s] for s in sizes if s not in fixed}
        share = {s: (total - sum(fixed.values())) * w / sum(free.values()) for s, w in free.items()}
        over = {s: 2 * sizes[s] for s in share if share[s] > 2 * sizes[s]}
        if not over:
            return fixed | share
        fixed |= over


def test_mix(spark, docs, texts, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = mixing.op5_source_mix(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in rows) == sorted((r["doc_id"], r["taken"]) for r in mixing.op5_source_mix(spark, str(tmp_path)).collect())
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in texts}
    of = {i: f"s{i % 3}" if i % 7 else None for i, _ in texts}
    sizes = {s: sum(n for i, n in words.items() if of[i] == s) for s in set(of.values())}
    order = sorted(s for s in sizes if s is not None) + [None]
    want = brute_targets(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)})
    taken = dict.fromkeys(sizes, 0)
    for r in rows:
        i = r["doc_id"]
        assert (r["size"], r["source_size"]) == (words[i], sizes[of[i]]) and abs(r["target"] - want[of[i]]) < 1e-6 * max(1, want[of[i]])
        assert r["taken"] <= 2 * r["size"] and r["taken"] % max(1, r["size"]) == 0
        taken[of[i]] += r["taken"]
    for s in sizes:
        others = sorted(n for i, n in words.items() if of[i] == s)
        assert abs(taken[s] - want[s]) <= 0.02 * sizes[s] + max(others) * (max(others) > 0.5 * sizes[s])


def test_flow_prefers_first_passes():
    gives = mixing.min_cost_flow({("a",): 100, ("a", "b"): 50, ("b",): 10}, {"a": 120, "b": 60}, 2)
    assert sum(gives.values()) == 180 and gives[("a",)] >= 100 and gives[("a", "b")] >= 50 and gives[("b",)] >= 10
    assert mixing.min_cost_flow({("a",): 10}, {"a": 100}, 2) == {("a",): 20}


def test_mix_of_overlapping_sources(spark):
    rows = [(i, "w " * 10, ["a", "b"] if i % 2 else ["a"]) for i in range(100)] + [(200, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, m array<string>")
    out, plan = mixing.mix(docs, F.col("m"), targets={"a": 600, "b": 300}, max_repeats=2)
    assert out.agg(F.sum(F.col("_size") * F.col("_copies"))).first()[0] == 900
    assert out.where("doc_id = 200").first()["_copies"] == 0


def test_mix_empty(empty):
    out, _ = mixing.mix(empty, F.array("source"), weigh=mixing.cycle_weights)
    assert out.count() == 0


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL", 40)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 100)
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        rows.append((i, rng.normal(size=6).tolist(), int(i % 2)))
    for i in range(300, 420):
        v = np.array(rows[i % 40][1]) + rng.normal(size=6) * 0.25
        rows.append((i, v.tolist(), int(i % 2)))
    rows += [(500 + i, rows[7][1], 1) for i in range(6)]
    rows += [(600, None, 1), (601, [0.0] * 6, 1), (602, [float("nan")] * 6, 1), (603, [None] + [1.0] * 5, 1), (604, [float("inf")] + [1.0] * 5, 1), (605, rows[7][1], None), (606, rows[7][1][:5], 1), (607, [], 0), (608, [3 * x for x in rows[7][1]], 1)]
    want, up = {}, {}
    good = {i: np.array(v) / np.linalg.norm(v) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    label = {i: lab for i, _, lab in rows}
    near = {i: [j for j in good if j != i and label[i] == label[j] and len(good[i]) == len(good[j]) and good[i] @ good[j] >= 0.93] for i in good}
    for i, _, _ in rows:
        seen, stack = {i}, [i]
        while stack:
            for j in near.get(stack.pop(), []):
                if j not in seen:
                    seen.add(j)
                    stack.append(j)
        up[i] = min(seen)
        want[i] = (len(near.get(i, [])), up[i], up[i] == i)
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<double>, label int, rep int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == want
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline as P

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = docs.select(*P.COLUMNS)
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "substring_dedup", "source_mix", "best_fit_packing"]
    kept = docs
    for name, stage in P.STAGES[:-1]:
        before = kept.count()
        kept = P.materialize(stage(spark, kept, str(tmp_path)), "test")
        assert kept.columns == list(P.COLUMNS), name
        if name != "source_mix":
            assert 0 < kept.count() <= before
    for name, stage in P.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
