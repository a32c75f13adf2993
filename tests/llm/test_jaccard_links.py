"""Numbers of links of the Jaccard join against brute force."""

from __future__ import annotations

import random

import pytest

from streamledger.llm import jaccard_join
from test_dedup import brute_components, shingles


def brute_links(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    return {i: sum(i != j and bool(a) and 100 * len(a & b) >= 80 * len(a | b) for j, b in sets) for i, a in sets}


@pytest.fixture(scope="module")
def clusters():
    """Near copies in large groups, where two copies of a leader need not link with each other; exact copies among them."""
    rng = random.Random(11)
    rows = []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(100)]
        for _ in range(50):
            w = list(base)
            for _ in range(rng.randrange(5)):
                w[rng.randrange(100)] = f"n{rng.randrange(40)}"
            rows += [(len(rows) + k, " ".join(w)) for k in range(rng.choice([1, 1, 1, 3]))]
    return rows


@pytest.mark.parametrize("block", [512, 16])
def test_links_match_brute_force(spark, clusters, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    got = {r["doc_id"]: r for r in jaccard_join.jaccard_join(spark.createDataFrame(clusters, "doc_id long, text string").repartition(3)).collect()}
    want = brute_links(clusters)
    assert len(set(want.values())) > 10
    assert {i: r["n_links"] for i, r in got.items()} == want
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == brute_components(clusters)


def test_links_of_odd_texts(docs, texts):
    got = {r["doc_id"]: r["n_links"] for r in jaccard_join.jaccard_join(docs).collect()}
    assert got == brute_links(texts)


def test_rows_that_repeat_a_doc_id_count(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (9, "a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_links"]) for r in jaccard_join.jaccard_join(docs).collect()), key=str)
    assert got == [(3, 2), (3, 2), (9, 2), (None, 0)]
