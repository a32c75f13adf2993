"""op5, op8, op9 and the pipeline, whole, against plain Python twins."""

from __future__ import annotations

import random
from collections import Counter
from functools import cache

import public_tokenizers
import pytest
import twins
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from streamledger.llm import mixing, packing, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows(texts) -> list[tuple]:
    """The shared odd texts, and 240 more of which 80 are rude in plain or disguised letters; two rows repeat, one has no id."""
    rng = random.Random(21)
    calm = ["".join(rng.choice("bcdfghkmnprtv") + rng.choice("aeou") for _ in range(rng.randrange(2, 5))) for _ in range(150)]
    rude = ["vrolgash", "snarkelt", "drethum", "quozzle", "gribnak"]
    disguise = [lambda w: w, str.upper, lambda w: w.replace("o", "0").replace("e", "3"), lambda w: w.replace("a", "а"), lambda w: w + "s"]
    out = [(i, t) for i, t in texts if i != 99]
    for i in range(240):
        words = [rng.choice(calm) for _ in range(rng.randrange(15, 60))]
        if i % 3 == 0:
            for _ in range(rng.randrange(3, 7)):
                words.insert(rng.randrange(len(words)), rng.choice(disguise)(rng.choice(rude)))
        elif i % 30 == 1:
            words[3:3] = ["garden", "gribnak"]
        out.append((200 + i, " ".join(words)))
    out += [out[-1], out[-2], (None, "one text without an id")]
    rng.shuffle(out)
    return [(i, t, "en", None if i is None or i % 7 == 0 else f"s{i % 3}", len(t or "")) for i, t in out]


@pytest.fixture(scope="module")
def labels() -> dict[int, int]:
    return {200 + i: int(i % 3 == 0) for i in range(240)} | {10: 0, 50: 0, 3: 0}


@pytest.fixture(scope="module")
def folder(spark, rows, labels, tmp_path_factory) -> str:
    at = str(tmp_path_factory.mktemp("twins"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def scored(rows, labels) -> list[float]:
    return twins.toxicity_scores([r[:2] for r in rows], {i: y for i, y in labels.items() if twins.trained(i)})


@cache
def plain() -> Tokenizer:
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def tokens(text) -> list[int]:
    return [*plain().encode(text or "", add_special_tokens=False).ids, 2]


def test_toxicity(spark, rows, labels, folder):
    want = scored(rows, labels)
    assert all(abs(s - 0.7) > 1e-6 for s in want) and 60 <= sum(s >= 0.7 for s in want) <= 90
    by_id = lambda x: (x[0] is not None, x[0] or 0, x[1])
    got = sorted(((r["doc_id"], r["score"], r["held_out"], r["predicted"]) for r in toxicity.op8_toxicity(spark, folder).collect()), key=by_id)
    want = sorted(zip([r[0] for r in rows], want, strict=True), key=by_id)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[0] == w[0] and abs(g[1] - w[1]) < 1e-9 and g[3] == int(w[1] >= 0.7), (g, w)
        assert g[0] is None or g[2] != twins.trained(g[0])


def hashes(spark, rows) -> list[int]:
    """The seeded hash of each row's doc_id, in order."""
    d = spark.createDataFrame([(k, r[0]) for k, r in enumerate(rows)], "k int, doc_id long")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return [r[0] for r in d.select(F.shiftrightunsigned(F.xxhash64(F.lit(0), key), 24), "k").orderBy("k").collect()]


def copies(spark, rows) -> list[int]:
    return twins.mixed([(r[3], len(twins.WORD.findall(r[1] or "")), h) for r, h in zip(rows, hashes(spark, rows), strict=True)])


def test_mix(spark, rows, folder):
    want = Counter((r[0], n * len(twins.WORD.findall(r[1] or ""))) for r, n in zip(rows, copies(spark, rows), strict=True))
    assert Counter((r["doc_id"], r["taken"]) for r in mixing.op5_source_mix(spark, folder).collect()) == want


def test_packing(spark, rows, folder):
    got = packing.op9_best_fit_packing(spark, folder).collect()
    want = Counter((r[0], *p) for r in rows for p in twins.pieces(tokens(r[1]), 1024))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    assert len({r["sequence_id"] for r in got}) <= len(twins.best_fit([p[3] for p in want.elements()], 1024))


def test_best_fit_equals_its_twin_and_the_bound_holds():
    rng = random.Random(12)
    for _ in range(150):
        lengths = packing.np.array([rng.randrange(1, 21) for _ in range(rng.randrange(1, 10))])
        _, _, left = packing.best_fit_decreasing(lengths, 20)
        assert sorted(20 - left) == sorted(twins.best_fit(lengths.tolist(), 20))
        fewest = twins.fewest_bins(lengths.tolist(), 20)
        assert packing.lower_bound(packing.np.bincount(lengths, minlength=21), 20) <= fewest <= len(left) <= fewest + 1


def test_pipeline(spark, rows, labels, folder):
    """Every stage gives the rows that its twin makes of the stage before, and ``run`` what the last one makes."""
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), rows
    for name, stage in P.STAGES[:-1]:
        if name == "toxicity":
            want = [r for r, s in zip(kept, scored(kept, labels), strict=True) if s < 0.7]
            assert len(kept) - 90 <= len(want) <= len(kept) - 60
        elif name == "near_duplicates":
            of = twins.components([r[:2] for r in kept])
            want = list(dict.fromkeys(r for r in kept if r[0] is None or of[r[0]] == r[0]))
            assert len(want) < len(kept) - 10
        elif name == "substring_dedup":
            cut = {i: (t, n, gone) for i, t, n, gone in twins.without_repeats([r[:2] for r in kept if r[0] is not None])}
            whole = lambda r: r[0] is None or cut[r[0]][2] == 0
            want = [r if whole(r) else (r[0], cut[r[0]][0], *r[2:4], len(cut[r[0]][0])) for r in kept if whole(r) or cut[r[0]][2] < cut[r[0]][1]]
            assert any(r[0] is not None and cut[r[0]][2] for r in kept)
        else:
            want = [r for r, n in zip(kept, copies(spark, kept), strict=True) for _ in range(n)]
        docs = P.materialize(stage(spark, docs, folder), "test")
        got = [tuple(r) for r in docs.collect()]
        assert Counter(got) == Counter(want), name
        kept = got
    want = Counter((r[0], *p) for r in kept for p in twins.pieces(tokens(r[1]), 1024))
    got = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in P.run(spark, folder).collect())
    assert got == want
