"""What a worker holds while it works on a chunk: arrays a window, whatever the texts are."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from streamledger.llm import exchange, jaccard_join, substring_dedup


def test_distinct_is_unique_with_places():
    rng = np.random.Generator(np.random.PCG64(4))
    for n, high in ((0, 1), (1, 1), (1000, 7), (1000, 2**63)):
        parts = [rng.integers(0, high, n, dtype=np.uint64), rng.integers(0, high, n // 3, dtype=np.uint64)]
        want = np.unique(np.concatenate(parts), return_index=True, return_inverse=True)
        for got, x in zip(exchange.distinct(parts), want, strict=True):
            assert (got == x).all()
        assert not parts and exchange.distinct([])[0].dtype == np.uint64


@pytest.mark.parametrize(("module", "run", "most"), [
    (substring_dedup, lambda docs: substring_dedup.remove_repeated_windows(docs), 45),
    (jaccard_join, lambda docs: jaccard_join._sets(docs, 5, 80), 50),
])
def test_a_chunk_takes_few_bytes_a_window(spark, monkeypatch, module, run, most):
    """The larger peak of both Python steps; it was 82 and 65 bytes a window."""
    held = {}
    monkeypatch.setattr(module, "exchange", lambda docs, columns, key, local, combine, finish, schema: held.update(local=local, finish=finish))
    run(spark.createDataFrame([], "doc_id long, text string"))
    rng = random.Random(6)
    words = [f"w{i}" for i in range(5000)]
    texts = [" ".join(rng.choices(words, k=1000)) for _ in range(600)]
    table = pa.table({"doc_id": pa.array(range(600), pa.int64()), "text": texts})
    keys, values = held["local"](table)
    answers = values[0] % 2
    del values
    peaks = []
    for step in (lambda: held["local"](table), lambda: held["finish"](table, [answers])):
        tracemalloc.start()
        before = tracemalloc.get_traced_memory()[0]
        step()
        peaks.append((tracemalloc.get_traced_memory()[1] - before) / len(keys))
        tracemalloc.stop()
    assert max(peaks) <= most, peaks
