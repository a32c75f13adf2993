"""Toxicity, language-model scores and revisits."""

from __future__ import annotations

import math
import random
from collections import Counter

from streamledger.llm import lm_scoring, revisits, toxicity


def test_fold():
    assert toxicity.fold("Іdi0t") == toxicity.fold("idiot")  # a Cyrillic letter, a digit
    assert toxicity.fold("TR4SH") == toxicity.fold("trash")
    assert toxicity.fold("ïdiöt") == toxicity.fold("idiot")
    assert toxicity.fold(None) == toxicity.fold("") == "  "


def test_lexicon_hits_exceptions_and_length():
    t = lambda w: toxicity.fold(w).strip()
    a = toxicity.Lexicon({t("trash"): 4.0, "^" + t("scum"): 3.0}, [t("trash can")]).automaton()
    w = lambda s: toxicity.weigh(a, toxicity.fold(s))
    assert w("you trash") == 4.0 and w("a trash can") == 0.0 and w("trash can of trash") == 4.0
    assert w("scumbag") == 3.0 and w("trashy") == 0.0 and w("subscum") == 0.0
    assert toxicity._density(4.0, " a b ") > toxicity._density(4.0, " a b " * 50)


def corpus(spark, n=240):
    rng = random.Random(2)
    bad = ["vile", "rotten", "nasty", "foul"]
    rows, labels = [], []
    for i in range(n):
        w = [f"c{rng.randrange(400)}" for _ in range(60)]
        if i % 3 == 0:
            for b in rng.sample(bad, 3):
                w[rng.randrange(60)] = b
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 3 == 0)))
    labels += [(None, 1, 1), (n + 5, 1, 1), (1, 1, None)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_held_out(spark):
    docs, labels = corpus(spark)
    lexicon = toxicity.learn(docs, toxicity.training_rows(labels))
    got = {r["doc_id"]: r for r in toxicity.score(docs, lexicon, "doc_id").collect()}
    import zlib

    held = [i for i in got if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 40
    assert sum(got[i]["_predicted"] == int(i % 3 == 0) for i in held) / len(held) > 0.95
    assert all(0 <= r["_score"] <= 1 and r["_predicted"] == int(r["_score"] >= 0.7) for r in got.values())


def test_toxicity_odd_rows(spark, docs, empty, texts):
    lexicon = toxicity.Lexicon({"vie": 3.0})
    rows = toxicity.score(docs, lexicon, "doc_id", "component_id").collect()
    assert len(rows) == len(texts) and all(r["_score"] < 0.7 for r in rows)
    assert toxicity.score(empty, lexicon).count() == 0
    assert toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int")).terms == {}


def test_cross_entropy_difference(spark, docs, texts):
    target = ["w1 w2 w3 w4", "w1 w2 zz", None]
    lower = lambda t: (t or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)}))
    import re

    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    D, G = [(i, split(t)) for i, t in texts], [split(t) for t in target]
    cd, cg, pd_, pg = Counter(), Counter(), Counter(), Counter()
    for _, w in D:
        cd.update(w)
        pd_.update(zip(w, w[1:], strict=False))
    for w in G:
        cg.update(w)
        pg.update(zip(w, w[1:], strict=False))
    td, tg = sum(cd.values()), sum(cg.values())
    A, B = lm_scoring.PRIOR_WORD, lm_scoring.PRIOR_PAIR
    got = {r["doc_id"]: r for r in lm_scoring.cross_entropy_difference(docs, spark.createDataFrame([(t,) for t in target], "text string")).collect()}
    for i, w in D:
        if not w:
            assert got[i]["score"] is None and got[i]["n_words"] == 0
            continue
        own, pairs = Counter(w), Counter(zip(w, w[1:], strict=False))
        bits = [0.0, 0.0]
        for k, x in enumerate(w):
            q = (cd[x] + cg[x]) / (td + tg)
            ps = (cg[x] + A * q) / (tg + A), (cd[x] - own[x] + A * q) / (td - len(w) + A)
            if k:
                v = w[k - 1]
                ps = (pg[v, x] + B * ps[0]) / (cg[v] + B), (pd_[v, x] - pairs[v, x] + B * ps[1]) / (cd[v] - own[v] + B)
            bits = [b - math.log2(p) for b, p in zip(bits, ps, strict=True)]
        assert abs(got[i]["target_bits"] - bits[0] / len(w)) < 1e-9
        assert abs(got[i]["background_bits"] - bits[1] / len(w)) < 1e-9
        assert abs(got[i]["score"] - (bits[0] - bits[1]) / len(w)) < 1e-9


def test_scores_of_empty_tables(spark, docs, empty):
    nothing = spark.createDataFrame([], "text string")
    assert lm_scoring.cross_entropy_difference(empty, nothing).count() == 0
    assert lm_scoring.cross_entropy_difference(docs, nothing).where("n_words > 0 AND score IS NULL").count() == 0


KIND = "record_id long, kind string, url string, ts long, status int, headers map<string,string>, digest string, body string"


def test_revisits(spark):
    rows = [
        (1, "response", "http://www.A.com:80/x/?b=2&a=1&utm_source=q#f", 10, 200, {"ETag": "\"1\"", "Date": "d1", "Content-Length": "9"}, "p", "one"),
        (2, "response", "https://a.com/x?a=1&b=2", 20, 200, {"ETag": "\"2\"", "Date": "d2", "etag": "\"2b\""}, "q", "two"),
        (3, "response", "https://a.com/x?a=1&b=2", 20, 200, {"ETag": "\"3\""}, "r", "three"),
        (4, "response", "https://a.com/x?a=1&b=2", 25, 404, {}, "z", "no"),
        (10, "revisit", "https://a.com/x?b=2&a=1", 15, 304, {"etag": "W/\"1\"", "date": "new", "content-length": "0"}, None, None),
        (11, "revisit", "https://a.com/x?b=2&a=1", 20, 304, {"etag": "\"1\""}, None, None),
        (12, "revisit", "https://a.com/x?b=2&a=1", 30, 304, {"etag": "\"9\""}, None, None),
        (13, "revisit", "https://a.com/x?b=2&a=1", 30, 304, None, "r", None),
        (14, "revisit", "https://a.com/x?b=2&a=1", 10, 304, {}, None, None),
        (15, "revisit", None, 30, 304, {}, None, None),
        (16, "revisit", "https://a.com/x?b=2&a=1", None, 304, {}, None, None),
        (17, "revisit", "https://a.com/x?b=2&a=1", 30, 304, {}, None, None),
        (17, "revisit", "https://a.com/x?b=2&a=1", 30, 304, {}, None, None),
    ]
    got = sorted(revisits.resolve_revisits(spark.createDataFrame(rows, KIND)).collect(), key=lambda r: r["record_id"])
    assert [(r["record_id"], r["response_id"], r["outcome"], r["body"]) for r in got] == [
        (10, 1, "resolved", "one"), (11, 1, "resolved", "one"), (12, 3, "changed", None), (13, 3, "resolved", "three"), (14, None, "no_capture", None),
        (15, None, "no_capture", None), (16, None, "no_capture", None), (17, 3, "unchecked", "three"), (17, 3, "unchecked", "three")]
    assert got[0]["headers"] == {"etag": "\"1\"", "date": "new", "content-length": "9"}


def test_hot_url_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(revisits, "HOT_LEAST", 20)
    rows = [(i, "response" if i % 5 == 0 else "revisit", "http://h/", i, 200 if i % 5 == 0 else 304, {}, None, f"b{i}") for i in range(300) if i > 2]
    got = revisits.resolve_revisits(spark.createDataFrame(rows, KIND)).collect()
    assert {r["record_id"]: r["response_id"] for r in got} == {i: (i // 5 * 5 or None) for i in range(3, 300) if i % 5}


def test_no_records(spark):
    assert revisits.resolve_revisits(spark.createDataFrame([], KIND)).collect() == []
