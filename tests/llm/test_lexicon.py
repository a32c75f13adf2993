"""The fitted lexicon: copies add no evidence, and no term is cut."""

from __future__ import annotations

import random
import time
from collections import defaultdict

from pyspark.sql import functions as F
from test_models import corpus

from streamledger.llm import toxicity


def test_copies_do_not_change_the_terms(spark):
    docs, labels = corpus(spark, 120)
    few = toxicity.learn(docs, labels)
    many = lambda d: d.select((F.col("doc_id") * 20).alias("at"), *d.columns[1:]).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("doc_id", F.col("at") + F.col("k"))
    copied = toxicity.learn(many(docs), many(labels))  # 400 toxic rows
    assert few.terms and copied.terms == few.terms


def test_all_terms_with_support_and_weight_are_kept(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghjkmnopqrstuvwxyz") for _ in range(10)) for _ in range(3000)]
    texts = [[] for _ in range(40)]
    for w in words:
        for t in rng.sample(texts, 3):
            t.append(w)
    support = defaultdict(set)
    for t in texts:
        for w in t:
            support[w].add(min(map(toxicity.hash_word, t)))
    rows = [(i, " ".join(t), 1) for i, t in enumerate(texts)] + [(100 + i, " ".join(f"c{rng.choice('bdfgh')}{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(40)), 0) for i in range(400)]
    rows = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    terms = toxicity.learn(rows.select("doc_id", "text"), rows.select("doc_id", "toxic")).terms
    known = {w for w, s in support.items() if len(s) >= 2}
    assert len(known) > 2500 and len(terms) > 4000
    assert known <= set(terms)


def test_many_hits_and_exceptions_take_linear_time():
    rng = random.Random(6)
    words = [toxicity.fold(w).strip() for w in ("vile", "rotten", "nasty", "calm", "kind")]
    lexicon = toxicity.Lexicon({words[0]: 2.0, words[1]: 3.0, "^nast": 1.5}, [f"{words[0]} {words[3]}", f"{words[4]} {words[0]}", f"{words[1]} {words[4]}"])
    machine = lexicon.automaton()

    def brute(text):
        """Word by word: the heaviest term of each word that no exception phrase covers."""
        w, total = text.split(), 0.0
        for i, x in enumerate(w):
            weights = [v for t, v in lexicon.terms.items() if t == x or (t[0] == "^" and x.startswith(t[1:]))]
            pairs = {" ".join(w[max(0, i - 1) : i + 1]), " ".join(w[i : i + 2])}
            if weights and not pairs & set(lexicon.exceptions):
                total += max(weights)
        return total

    for _ in range(50):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))
        assert toxicity.weigh(machine, toxicity.fold(text)) == brute(text)
    long = " ".join(rng.choice(words) for _ in range(400_000))  # 2 MB
    began = time.time()
    toxicity.weigh(machine, toxicity.fold(long))
    assert time.time() - began < 10


def test_slices_keep_all_rows():
    import pyarrow as pa

    rng = random.Random(1)
    texts = [None if i % 50 == 7 else "x" * (3 << 20 if i == 40 else rng.randrange(9000)) for i in range(700)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(700))], ["text", "i"])
    slices = list(toxicity._slices([batch, batch.slice(0, 0), batch.slice(300, 100)], "text"))
    assert [x for s in slices for x in s.column("i").to_pylist()] == [*range(700), *range(300, 400)]
    assert all(s.num_rows <= toxicity.SLICE and (s.num_rows == 1 or sum(len(x or "") for x in s.column("text").to_pylist()) <= toxicity.SLICE_BYTES) for s in slices)
