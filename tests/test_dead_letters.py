"""Dead letters of a claim: all that were delivered too often, whatever their number."""

from __future__ import annotations

from pyspark.sql import functions as F

from streamledger.sources.store import LogStore


def test_all_records_past_the_limit_are_diverted(spark, tmp_path):
    store = LogStore(spark, f"file://{tmp_path}/store")
    store.put_topic("q", type="queue", lease_ms=1000, max_deliveries=1, dead_letter="dead")
    store.append("q", spark.range(10_050).select(F.col("id").alias("pos"), F.concat(F.lit("d"), "id").alias("data"), F.lit("a").alias("tag")), 0)
    n, none = 10_040, F.lit(None).cast("long")
    events = spark.range(1, n + 1).select(F.col("id").alias("seq"), F.lit("claimed").alias("event"), F.lit("w").alias("node"), F.col("id").alias("lease_id"), F.lit(1000).cast("long").alias("deadline_ms"), none.alias("ready_at_ms"), F.lit(0).cast("long").alias("ts_ms"))
    store._lease_events(store.manifest(), "q", events)
    taken = store.claim("q", "w", 20, 5000)
    assert sorted(r["seq"] for r in taken.collect()) == list(range(n + 1, n + 11))
    assert store.records("dead").select("data").distinct().count() == n
    assert store.live("q").count() == 10
