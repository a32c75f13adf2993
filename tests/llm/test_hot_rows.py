"""Hot groups, repeated ids, clashing names, and the flow, against brute force."""

from __future__ import annotations

import random
import time
from itertools import chain, combinations

from pyspark.sql import functions as F

from streamledger.llm import embedding_dedup, jaccard_join, mixing, revisits, sharding
from streamledger.llm.components import components


def most_flow(patterns, targets, passes):
    """By the least cut, over all sets of sources."""
    sources = sorted({s for p in patterns for s in p})
    sets = chain.from_iterable(combinations(sources, n) for n in range(len(sources) + 1))
    return min(sum(targets[s] for s in a) + sum(passes * n for p, n in patterns.items() if set(p) - set(a)) for a in sets)


def test_flow_is_the_largest_and_the_cheapest():
    rng = random.Random(3)
    for _ in range(120):
        sources = "abcde"[: rng.randrange(1, 6)]
        patterns = {tuple(sorted(rng.sample(sources, rng.randrange(1, len(sources) + 1)))): rng.randrange(0, 30) for _ in range(rng.randrange(1, 9))}
        targets = {s: rng.randrange(0, 80) for s in sources}
        repeats = rng.randrange(1, 4)
        gives = mixing.min_cost_flow(patterns, targets, repeats)
        most = [most_flow(patterns, targets, k) for k in range(repeats + 1)]
        assert sum(gives.values()) == most[-1]
        cost = sum(k * min(n, max(0, gives[p] - k * n)) for p, n in patterns.items() for k in range(repeats))
        assert cost == sum(k * (most[k + 1] - most[k]) for k in range(repeats))
        assert all(gives[p] <= repeats * n for p, n in patterns.items())


def test_flow_over_many_patterns_is_quick():
    rng = random.Random(4)
    sources = [f"s{i:02d}" for i in range(40)]
    patterns = {}
    while len(patterns) < mixing.MAX_PATTERNS:
        patterns[tuple(sorted(rng.sample(sources, rng.randrange(1, 5))))] = rng.randrange(1, 10_000)
    targets = {s: rng.randrange(1, 8_000_000) for s in sources}
    began = time.time()
    gives = mixing.min_cost_flow(patterns, targets, 2)
    assert sum(gives.values()) <= sum(targets.values()) and time.time() - began < 60


def test_kept_columns_may_have_any_name(spark):
    docs = spark.createDataFrame([(i, f"w{i} w", i * 7, -i, "k") for i in range(60)], "doc_id long, text string, depth long, part long, hash string")
    got = {r["doc_id"]: r for r in sharding.extendible_shards(docs, 40, keep=("doc_id", "depth", "part", "hash")).collect()}
    plain = {r["doc_id"]: r for r in sharding.extendible_shards(docs, 40).collect()}
    for i, r in got.items():
        assert (r["depth"], r["part"], r["hash"]) == (i * 7, -i, "k")
        assert (r["_depth"], r["_part"], r["shard"]) == (plain[i]["depth"], plain[i]["part"], plain[i]["shard"])
    named = docs.withColumnsRenamed({"depth": "whole", "part": "pattern"}).withColumn("cut", F.lit(5)).withColumn("extra", F.lit("e"))
    out, _ = mixing.mix(named, F.array(F.lit("s")), targets={"s": 100}, keep=("doc_id", "whole", "pattern", "cut", "extra", "hash"))
    assert {(r["doc_id"], r["whole"], r["pattern"], r["cut"], r["extra"], r["hash"]) for r in out.collect()} == {(i, i * 7, -i, 5, "e", "k") for i in range(60)}


def test_repeated_ids_are_one_node(spark):
    rng = random.Random(9)
    a, b, c = (" ".join(f"{x}{rng.randrange(500)}" for _ in range(60)) for x in "abc")
    rows = [(5, a), (5, b), (3, b), (1, a), (9, c), (7, c), (9, a), (20, "alone"), (None, a)]
    for parts in (1, 4):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = {(r["doc_id"], r["component_id"]) for r in jaccard_join.jaccard_join(docs).collect()}
        assert got == {(i, 1) for i in (1, 3, 5, 7, 9)} | {(20, 20), (None, None)}


def test_large_groups_of_near_copies(spark, monkeypatch):
    """Groups and blocks of a few documents, so that a label has many; links against brute force."""
    monkeypatch.setattr(jaccard_join, "GROUP", 4)
    monkeypatch.setattr(jaccard_join, "QUERIES", 3)
    monkeypatch.setattr(jaccard_join, "BLOCK", 5)
    rng = random.Random(12)
    base = [[f"w{rng.randrange(900)}" for _ in range(80)] for _ in range(3)]
    rows = []
    for i in range(90):
        w = list(base[i % 3])
        for _ in range(i % 5):
            w[rng.randrange(80)] = f"n{i}"
        rows.append((i, " ".join(w[: 80 - i % 4])))
    shingles = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    link = {i: {j for j in shingles if i != j and 100 * len(shingles[i] & shingles[j]) >= 80 * len(shingles[i] | shingles[j])} for i in shingles}
    low = {}
    for i in shingles:
        seen, stack = {i}, [i]
        while stack:
            new = link[stack.pop()] - seen
            seen |= new
            stack += new
        low[i] = min(seen)
    got = {r["doc_id"]: (r["n_links"], r["component_id"]) for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (len(link[i]), low[i]) for i in shingles}


def test_components_of_a_star_and_chains(spark):
    rng = random.Random(2)
    edges = [(0, i) for i in range(1, 300)] + [(i, i + 1) for i in range(1000, 1040)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(90)] + [(None, 4), (7, 7)]
    up = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["id"]: r["component"] for r in got} == {x: find(x) for x in up} and len(got) == len(up)


def test_hot_url_crawled_in_one_burst(spark, monkeypatch):
    monkeypatch.setattr(revisits, "HOT_LEAST", 20)
    rows, want = [], {}
    for i in range(400):  # other urls, over a long time
        rows.append((10_000 + i, "response", f"http://e.org/{i}", i * 1_000_000, 200, {"ETag": "x"}, None, "b"))
    last = None
    for t in range(300):  # one url, within a second
        if t % 7 == 0:
            last = 20_000 + t
            rows.append((last, "response", "http://hot.org/", 5_000 + t, 200, {"ETag": "e"}, None, f"body{t}"))
        else:
            rows.append((30_000 + t, "revisit", "http://hot.org/", 5_000 + t, 304, {"ETag": "e"}, None, None))
            want[30_000 + t] = last
    df = spark.createDataFrame(rows, "record_id long, kind string, url string, ts long, status int, headers map<string,string>, digest string, body string")
    got = {r["record_id"]: (r["response_id"], r["outcome"]) for r in revisits.resolve_revisits(df).collect()}
    assert got == {i: (r, "resolved") for i, r in want.items()}


def test_vectors_of_extreme_size(spark):
    rows = [(1, [1e200, 2e200, 0.0], 1), (2, [1e-200, 2e-200, 0.0], 1), (3, [0.0, 0.0, 5e180], 1)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3)}
