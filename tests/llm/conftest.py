from __future__ import annotations

import random

import pytest

WORDS = [f"w{i}" for i in range(60)]


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def texts() -> list[tuple]:
    """(doc_id, text): nulls, blanks, short, very long, copies, near copies, shared passages, other scripts, separators of all kinds."""
    rng = random.Random(5)
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "One"), (5, "a b c d"), (6, "a  b\x0bc\x0cd"), (7, "naïve 日本 ① x 😀 end")]
    base = sentence(rng, 120)
    rows += [(10 + i, base) for i in range(5)]
    for i in range(20):
        w = base.split()
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = f"new{i}"
        rows.append((20 + i, " ".join(w)))
    passage = sentence(rng, 30)
    rows += [(50 + i, f"{sentence(rng, 25)} {passage}\n{sentence(rng, 25)}") for i in range(12)]
    rows += [(70 + i, sentence(rng, rng.randrange(1, 60))) for i in range(20)]
    rows.append((99, sentence(rng, 30_000)))
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """With other columns whose names the operators use inside."""
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or ""), 1, "x", 0, 2) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id int, size string, _chunk int, part int").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
