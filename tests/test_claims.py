"""Claims that are gathered, connections that are pushed to, classes of durability."""

from __future__ import annotations

import pytest

from streamledger.errors import LedgerError
from streamledger.operators.bodies import parsed
from streamledger.operators.catalog import normalize_config
from streamledger.sources.store import LogStore


def queue(spark, tmp_path, **config):
    store = LogStore(spark, f"file://{tmp_path}/store")
    store.put_topic("q", type="queue", **config)
    store.append("q", spark.createDataFrame([(i, f"d{i}") for i in range(6)], "pos long, data string"), 0)
    return store


def test_claims_within_the_wait_are_divided(spark, tmp_path):
    store = queue(spark, tmp_path, claim_jitter_ms=50)
    first, second = store.claim_gathered("q", [(10, "a", 3, None), (59, "b", 3, None), (60, "c", 9, None)])
    assert sorted((r["seq"], r["node"], r["deadline_ms"]) for r in first.collect()) == [(i + 1, "ab"[i % 2], 30_060) for i in range(6)]
    assert second.count() == 0


def test_push_fills_what_a_connection_may_hold(spark, tmp_path):
    store = queue(spark, tmp_path)
    one = store.push("q", "a", "c1", 2, 10)
    assert sorted(r["seq"] for r in one.collect()) == [1, 2] and store.push("q", "a", "c1", 2, 20).count() == 0
    store.ack("q", spark.createDataFrame([(1, "a", None)], "seq long, node string, lease_id long"), 30)
    assert [r["seq"] for r in store.push("q", "a", "c1", 2, 40).collect()] == [3]
    assert sorted(r["seq"] for r in store.push("q", "a", "c2", 1, 50).collect()) == [4]
    store.disconnect("q", "c1", 60)
    assert sorted(r["seq"] for r in store.push("q", "b", "c3", 9, 70).collect()) == [2, 3, 5, 6]


def test_durability(spark):
    assert [(normalize_config(c)["durability"], normalize_config(c)["durable"]) for c in ({}, {"durable": True}, {"durable": True, "durability": "memory"}, {"durability": "fsync"})] == [
        ("disk", False), ("fsync", True), ("memory", False), ("fsync", True)]
    with pytest.raises(LedgerError):
        normalize_config({"durability": "tape"})


def test_bodies(spark):
    rows = [(1, '{"records":[{"data":null,"tag":"t"},{"data":[1,{"b":2}],"node":"n","meta":null}],"node":"own"}'), (2, '{"records":[]}'), (3, '{"records":[{"data":1},{"tag":"x"}]}'), (4, "{"), (5, None), (6, "7")]
    got = sorted(tuple(r) for r in parsed(spark.createDataFrame(rows, "request long, body string")).where("problem IS NULL").collect())
    assert got == [(1, 0, "null", "t", "own", None, None), (1, 1, '[1,{"b":2}]', None, "n", None, None)]
    bad = {r["request"]: r["problem"] for r in parsed(spark.createDataFrame(rows, "request long, body string")).where("problem IS NOT NULL").collect()}
    assert bad == {2: "a write has at least one record", 3: "a record has data", 4: "malformed JSON body", 5: "malformed JSON body", 6: "a write has at least one record"}
