"""The store: dense numbers, deletes, loss markers, leases, crash safety."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from streamledger.errors import LedgerError
from streamledger.sources.store import LogStore


@pytest.fixture
def store(spark, tmp_path):
    return LogStore(spark, f"file://{tmp_path}/store")


def batch(spark, n, tags=("a", "b")):
    return spark.createDataFrame([(i, f"d{i}", tags[i % len(tags)]) for i in range(n)], "pos long, data string, tag string")


def seqs(df):
    return sorted(r[0] for r in df.select("seq").collect())


def test_numbers_are_dense_and_never_used_twice(spark, store):
    assert store.append("t", batch(spark, 5), 1000) == (1, 5)
    store.delete("t", before_seq=6)
    assert store.append("t", batch(spark, 2), 2000) == (6, 7)
    assert seqs(store.live("t")) == [6, 7]
    assert seqs(store.records("t")) == [1, 2, 3, 4, 5, 6, 7]


def test_parts_without_manifest_are_invisible(spark, store):
    store.append("t", batch(spark, 3), 1000)
    store._part("records", store.records("t").withColumn("seq", F.col("seq") + 100), topic="t")
    assert seqs(store.records("t")) == [1, 2, 3]


def test_second_writer_fails(spark, store):
    m = store.manifest()
    store.append("t", batch(spark, 1), 1000)
    with pytest.raises(LedgerError):
        store._publish(m)


def test_delete_is_pinned_in_time(spark, store):
    store.append("t", batch(spark, 4), 1000)
    store.delete("t", match="a")
    store.append("t", batch(spark, 2), 2000)
    assert seqs(store.live("t")) == [2, 4, 5, 6]


def test_cap_loss_is_marked_and_delete_is_silent(spark, store):
    store.append("t", batch(spark, 10), 1000)
    store.delete("t", before_seq=4)
    _, marker = store.diff("t", 0, 2000)
    assert not marker.first()["marked"]
    store.put_topic("t", cap_records=4)
    page, marker = store.diff("t", 0, 2000)
    m = marker.first()
    assert (m["gap_from"], m["gap_to"], m["reason"]) == (1, 6, "cap")
    assert seqs(page) == [7, 8, 9, 10]


def test_floors_never_fall(spark, store):
    store.append("t", batch(spark, 10), 1000)
    store.put_topic("t", cap_records=4)
    store.harden("t", 2000)
    store.put_topic("t")
    assert store.state("t", 2000).first()["earliest_seq"] == 7


def test_compaction_keeps_what_lives(spark, store):
    store.append("t", batch(spark, 10), 1000)
    store.delete("t", match="a")
    before = store.live("t").orderBy("seq").collect()
    assert store.compact("t", 2000) == 5
    assert store.live("t").orderBy("seq").collect() == before
    assert store.append("t", batch(spark, 1), 3000) == (11, 11)


def test_reject(spark, store):
    store.put_topic("t", discard="reject", cap_records=3)
    store.append("t", batch(spark, 2), 1000)
    with pytest.raises(LedgerError, match="t") as e:
        store.append("t", batch(spark, 2), 1000)
    assert e.value.code == "topic_full"


def test_type_is_immutable(spark, store):
    store.put_topic("t", type="queue")
    with pytest.raises(LedgerError) as e:
        store.put_topic("t", type="log")
    assert e.value.code == "topic_exists_incompatible"


def test_queue_round(spark, store):
    store.put_topic("q", type="queue", lease_ms=1000, max_deliveries=2, dead_letter="dead")
    store.append("q", batch(spark, 4), 0)
    assert seqs(store.claim("q", "w", 2, 5000)) == [1, 2]
    ask = lambda *rows: spark.createDataFrame(list(rows), "seq long, node string, lease_id long")
    assert seqs(store.ack("q", ask((1, "w", None), (2, "other", None)), 5500)) == [1]
    assert seqs(store.nack("q", ask((2, "w", 2)), 5600, 10_000)) == [2]
    assert seqs(store.claim("q", "w", 5, 5700)) == [3, 4]
    assert seqs(store.claim("q", "w", 5, 16_000)) == [2, 3, 4]
    assert seqs(store.claim("q", "w", 5, 30_000)) == []
    assert sorted(r["data"] for r in store.records("dead").collect()) == ["d1", "d2", "d3"]


def test_delete_topic_takes_its_routers(spark, store):
    store.put_topic("a")
    m = store.manifest()
    m["routers"] = {"r": {"source": "a", "dest": "b"}, "s": {"source": "c", "dest": "b"}}
    store._publish(m)
    assert store.delete_topic("a") == ["r"]
