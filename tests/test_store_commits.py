"""The store's writes, routers and commits."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from streamledger.errors import LedgerError
from streamledger.operators import router as O
from streamledger.sources.store import LogStore


@pytest.fixture
def store(spark, tmp_path):
    return LogStore(spark, f"file://{tmp_path}/store")


def batch(spark, n, tags=("a", "b")):
    return spark.createDataFrame([(i, f"d{i}", tags[i % len(tags)]) for i in range(n)], "pos long, data string, tag string")


def seqs(df):
    return sorted(r[0] for r in df.select("seq").collect())


def code(f, *a, **k):
    with pytest.raises(LedgerError) as e:
        f(*a, **k)
    return e.value.code


def test_key_answers_within_its_window(spark, store):
    first = store.write("t", batch(spark, 3), 1000, idempotency_key="k")
    assert store.write("t", batch(spark, 2), 121_000, idempotency_key="k") == first | {"deduped": True}
    assert store.write("t", batch(spark, 2), 121_001, idempotency_key="k")["first_seq"] == 4
    assert seqs(store.live("t")) == [1, 2, 3, 4, 5]


def test_limits_of_a_write(spark, store):
    assert code(store.write, "t", batch(spark, 0), 0) == "invalid_request"
    assert code(store.write, "t", spark.range(10_001).select(F.col("id").alias("pos"), F.lit("x").alias("data")), 0) == "batch_too_large"
    assert code(store.write, "t", batch(spark, 1), 0, idempotency_key="k" * 257) == "invalid_request"
    assert code(store.write, "t", batch(spark, 1), 0, config={"auto_create": False}) == "topic_not_found"


def test_retention_comes_before_admission(spark, store):
    store.put_topic("t", discard="reject", cap_records=3, ttl_ms=1000)
    store.append("t", batch(spark, 3), 1000)
    assert code(store.append, "t", batch(spark, 1), 1500) == "topic_full"
    assert code(store.append, "t", batch(spark, 4), 9000) == "record_too_large"
    assert store.append("t", batch(spark, 2), 9000) == (4, 5)


def test_quota_over_all_logs(spark, tmp_path):
    store = LogStore(spark, f"file://{tmp_path}/store", max_total_bytes=8)
    store.append("a", batch(spark, 2), 0)
    store.append("b", batch(spark, 2), 0)
    assert code(store.append, "b", batch(spark, 1), 0) == "throttled"


def test_a_claim_that_dies_before_its_commit_changes_nothing(spark, store, monkeypatch):
    store.put_topic("q", type="queue", lease_ms=1000, max_deliveries=1, dead_letter="dead")
    store.append("q", batch(spark, 3).withColumn("meta", F.lit('{"k":[1]}')), 0)
    assert seqs(store.claim("q", "w", 2, 0)) == [1, 2]
    with monkeypatch.context() as p:
        p.setattr(store, "_publish", lambda m: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            store.claim("q", "w", 5, 5000)
    assert seqs(store.live("q")) == [1, 2, 3] and "dead" not in store.manifest()["logs"]
    version = store.manifest()["version"]
    assert seqs(store.claim("q", "w", 5, 5000)) == [3]
    assert store.manifest()["version"] == version + 1  # copies, deletes and leases in one
    meta = [json.loads(r["meta"]) for r in store.live("dead").orderBy("seq").collect()]
    assert meta == [{"k": [1], "$dead_letter_from": "q", "$dead_letter_deliveries": "1", "$dead_letter_src_seq": str(i)} for i in (1, 2)]
    assert store.counters("q", 5000).first().asDict() == {"live": 1, "ready": 0, "in_flight": 1, "delayed": 0, "dead_lettered": 2}


def test_ack_is_one_commit_and_checked_first(spark, store):
    store.put_topic("q", type="queue", lease_ms=1000)
    store.append("q", batch(spark, 2), 0)
    store.claim("q", "w", 2, 0)
    ask = spark.range(1, 1002).select(F.col("id").alias("seq"), F.lit("w").alias("node"), F.lit(None).cast("long").alias("lease_id"))
    version = store.manifest()["version"]
    assert code(store.ack, "q", ask, 10) == "invalid_request" and store.manifest()["version"] == version
    assert seqs(store.ack("q", ask.where("seq = 2"), 10)) == [2]
    assert store.manifest()["version"] == version + 1 and seqs(store.live("q")) == [1]


def test_compaction_drops_leases_of_what_is_gone(spark, store):
    store.put_topic("q", type="queue", lease_ms=1000)
    store.append("q", batch(spark, 4), 0)
    store.claim("q", "w", 3, 0)
    store.ack("q", spark.createDataFrame([(1, "w", None), (2, "w", None)], "seq long, node string, lease_id long"), 10)
    store.compact("q", 20)
    assert seqs(store.leases("q", 20)) == [3]
    assert seqs(store.claim("q", "w", 9, 20)) == [4]


def test_router_rules(spark, store):
    store.append("a", batch(spark, 2), 0)
    store.put_router("r", "a", "b", match="a")
    assert store.router("r")["lag"] == 0  # from the head on
    assert code(store.put_router, "r2", "c", "b") == "topic_exists_incompatible"
    assert code(store.put_router, "r", "a", "c") == "topic_exists_incompatible"
    assert code(store.put_router, "r3", "b", "a") == "router_cycle"
    assert code(store.put_router, "r3", "b", "b") == "invalid_request"
    assert code(store.put_router, "r3", "b", "new", create_dest=False) == "topic_not_found"
    assert code(store.router, "none") == "router_not_found"
    store.max_routers = 1
    assert code(store.put_router, "r4", "b", "c") == "throttled"
    assert [tuple(r) for r in store.routers().collect()] == [("r", "a", "b")]
    store.delete_router("r")
    assert store.routers().count() == 0


def test_reads_see_what_routers_bring(spark, store):
    store.put_router("r", "a", "b", match="a")
    store.put_router("s", "b", "c")
    store.append("a", batch(spark, 5), 100)
    page, _ = store.diff("c", 0, 200)  # through both
    assert [r["data"] for r in page.orderBy("seq").collect()] == ["d0", "d2", "d4"]
    assert store.drain(300) == 0  # nothing twice


def test_forward_is_one_commit(spark, store, monkeypatch):
    store.put_router("r", "a", "b")
    store.append("a", batch(spark, 3), 0)
    with monkeypatch.context() as p:
        p.setattr(store, "_publish", lambda m: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            store.drain(10)
    assert store.router("r")["lag"] == 3 and store.live("b").count() == 0
    assert store.drain(20) == 3 and seqs(store.live("b")) == [1, 2, 3]


def test_backpressure_and_cycles(spark, store):
    store.put_topic("b", discard="reject", cap_records=2)
    store.put_router("r", "a", "b", match="a")
    store.append("a", batch(spark, 7), 0)
    assert store.drain(10) == 2 and store.router("r")["cursor"] == 4  # the third that matches is 5
    store.delete("b", before_seq=2)
    assert store.drain(20) == 1
    store.put_router("x", "c", "d")
    store.put_router("y", "d", "c", allow_cycle=True)
    store.append("c", batch(spark, 1), 0)
    assert store.drain(30) == 8  # the hop cap ends it


def test_reachable_on_a_complete_graph(spark):
    names = "abcd"
    edges = spark.createDataFrame([(a, b) for a in names for b in names if a != b], "source string, dest string")
    assert {tuple(r) for r in O.reachable(edges).collect()} == {(a, b) for a in names for b in names}
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(6)], "source string, dest string")
    assert O.reachable(chain).count() == 21
