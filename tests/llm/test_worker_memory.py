"""What executors hold beside a task's own rows: batches of texts, daemons of Python workers, the tokenizer's arrays."""

from __future__ import annotations

import random
import tracemalloc

import pyarrow as pa
import public_tokenizers
import pytest

from streamledger.llm import packing, runtime, tokens


def test_texts_are_read_few_at_a_time(spark, docs):
    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"]
    before = [spark.conf.get(n) for n in names]
    try:
        for n in names:
            spark.conf.unset(n)
        assert runtime.small_batches(docs) is docs
        assert [spark.conf.get(n) for n in names] == ["1024", "512"]
        spark.conf.set(names[1], "100")
        runtime.small_batches(docs)
        assert spark.conf.get(names[1]) == "100"  # what is smaller stays
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)


@pytest.mark.parametrize(("rows", "schema"), [
    ([], "pattern int, hash long"),
    ([(1, -(2**63)), (None, 2**63 - 1)], "pattern int, hash long"),
    ([([None, "a"], 0), ([], 1), (None, 2)], "members array<string>, pattern int"),
    ([(i, i % 2) for i in range(5000)], "doc_id long, toxic int"),
])
def test_local_rows_need_no_python(spark, rows, schema):
    df = runtime.local_rows(spark, rows, schema)
    assert df.schema == spark.createDataFrame(rows, schema).schema
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, rows))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan, plan


def test_a_tokenizing_worker_holds_a_slice(monkeypatch):
    """It was 52 MB in this test."""
    held = {}

    class Docs:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            held["run"] = run

    monkeypatch.setattr(packing, "small_batches", lambda docs: docs)
    monkeypatch.setattr(packing, "F", type("F", (), {"col": lambda name: type("C", (), {"cast": lambda self, kind: self, "alias": lambda self, name: self})()}))
    path = public_tokenizers.path("byte_bpe_50k.json")
    packing.token_pieces(Docs(), path, 1024, 2)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(5000)]
    batch = pa.record_batch({"doc_id": pa.array(range(250), pa.int64()), "text": [" ".join(rng.choices(words, k=1000)) for _ in range(250)]})
    tokens.tokenizer(path).forget()
    first = [b.to_pydict() for b in held["run"]([batch])]
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        again = [b.to_pydict() for b in held["run"]([batch])]
        most = (tracemalloc.get_traced_memory()[1] - before) / 1e6
    finally:
        tracemalloc.stop()
    assert again == first and most < 20, most
