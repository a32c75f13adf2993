"""Floors, watermarks and loss markers. A floor is the highest sequence lost to a cause."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import expired, loss_reason
from .append import prefix_sums
from .runs import greedy_runs

FLOORS = ("evict_floor", "expiry_floor", "delete_floor", "source_trim_floor")


def floors(log: DataFrame, now_ms: int, ttl_ms: int = 0, cap_records: int = 0, cap_bytes: int = 0, before_seq: int = 0, trimmed_to: int = 0) -> DataFrame:
    """One row a topic: head and the four floors.

    Expiry takes the expired prefix only (it stops at the first record that lives). The records cap is arithmetic on seq. The
    bytes cap keeps the newest records that fit.
    """
    base = log.groupBy("topic").agg(
        F.max("seq").alias("head"),
        (F.coalesce(F.min(F.when(~expired(ttl_ms, now_ms), F.col("seq"))), F.max("seq") + 1) - 1).alias("first_alive"),
        F.min("seq").alias("base"),
    )
    expiry = F.when(F.col("first_alive") >= F.col("base"), F.col("first_alive")).otherwise(F.lit(0)) if ttl_ms else F.lit(0)
    out = base.withColumn("expiry_floor", expiry.cast("long")).withColumn("records_floor", (F.greatest(F.col("head") - cap_records, F.lit(0)) if cap_records else F.lit(0)).cast("long"))
    if cap_bytes:
        newest = prefix_sums(log.select("topic", "seq", "bytes"), ["topic"], "seq", "bytes", "kept", descending=True)
        size = newest.groupBy("topic").agg(F.max(F.when(F.col("kept") > cap_bytes, F.col("seq"))).alias("bytes_floor"))
        out = out.join(size, "topic").fillna(0, ["bytes_floor"])
    else:
        out = out.withColumn("bytes_floor", F.lit(0).cast("long"))
    trim = F.least(F.lit(trimmed_to), F.col("head")).cast("long")
    gone = F.least(F.lit(max(before_seq - 1, 0)), F.col("head")).cast("long")
    out = out.withColumn("evict_floor", F.greatest("records_floor", "bytes_floor")).withColumn("delete_floor", gone).withColumn("source_trim_floor", trim)
    return out.select("topic", "head", "base", *FLOORS)


def hardened(computed: DataFrame, history: DataFrame) -> DataFrame:
    """Floors never fall: the greatest of what is computed and what was observable before (``history``: topic and floors)."""
    past = history.groupBy("topic").agg(*[F.max(f).alias(f"past_{f}") for f in FLOORS])
    out = computed.join(past, "topic", "left")
    for f in FLOORS:
        out = out.withColumn(f, F.greatest(f, F.coalesce(f"past_{f}", F.lit(0)).cast("long")))
    return out.drop(*[f"past_{f}" for f in FLOORS])


def watermarks(state: DataFrame, live: DataFrame) -> DataFrame:
    """``state`` (of ``floors``) with earliest_seq (first live record, else head + 1) and evict_earliest (involuntary loss only)."""
    above = live.join(state.select("topic", *FLOORS), "topic").where(F.col("seq") > F.greatest(*FLOORS))
    first = above.groupBy("topic").agg(F.min("seq").alias("first_live"), F.count("*").alias("count"), F.sum("bytes").cast("long").alias("bytes"))
    out = state.join(first, "topic", "left").withColumn("earliest_seq", F.coalesce("first_live", F.col("head") + 1)).drop("first_live")
    return out.withColumn("evict_earliest", F.greatest("evict_floor", "expiry_floor", "source_trim_floor") + 1).fillna(0, ["count", "bytes"])


def tombstones(state: DataFrame, from_seq: int, connecting: bool = False) -> DataFrame:
    """One row a topic: does a read from ``from_seq`` have to report loss? gap_from, gap_to, reason, missed_estimate, resume_from.

    Voluntary deletes are silent. A cursor past the head means that the topic was made anew. The first read of a push
    connection (``connecting``) names a gap from_seq_too_old.
    """
    new = F.lit(from_seq) > F.col("head")
    lost = F.lit(from_seq + 1) < F.col("evict_earliest")
    start = F.when(new, F.col("base")).otherwise(F.lit(from_seq + 1))
    stop = F.when(new, F.col("head")).otherwise(F.col("evict_earliest") - 1)
    reason = F.when(new, F.lit("recreated")).otherwise(F.lit("from_seq_too_old") if connecting else loss_reason(F.lit(from_seq + 1)))
    any_ = new | lost
    resume = F.when(new, F.col("earliest_seq") - 1).when(lost, F.greatest(F.col("earliest_seq") - 1, F.lit(from_seq))).otherwise(F.lit(from_seq))
    return state.select(
        "topic", "head", "earliest_seq", "evict_earliest", any_.alias("marked"), F.when(any_, start).cast("long").alias("gap_from"), F.when(any_, stop).cast("long").alias("gap_to"),
        F.when(any_, reason).alias("reason"), F.when(any_, stop - start + 1).cast("long").alias("missed_estimate"), resume.cast("long").alias("resume_from"))


def tier_plan(segments: DataFrame, keep_newest: int, keep_bytes: int) -> DataFrame:
    """Which sealed segments stay hot: the newest ``keep_newest``, and the newest while their bytes fit ``keep_bytes``.

    ``segments`` has topic, first_seq, bytes, sealed. A topic's catalog is one window: it has a row for a file.
    """
    newest = Window.partitionBy("topic").orderBy(F.desc("first_seq"))
    rows = segments.where("sealed").withColumn("age", F.row_number().over(newest)).withColumn("held", F.sum("bytes").over(newest.rowsBetween(Window.unboundedPreceding, 0)))
    hot = (F.col("age") <= keep_newest) | (F.col("held") <= keep_bytes)
    return rows.select("topic", "first_seq", "bytes", F.when(hot, "hot").otherwise("cold").alias("tier"))


def seal_segments(log: DataFrame, max_records: int, max_bytes: int = 0, max_age_ms: int = 0) -> DataFrame:
    """(topic, segment, first_seq, last_seq, records, bytes): segments as a writer seals them, each count starting anew.

    Before a record is written, the open segment is sealed if it has ``max_records`` records, ``max_bytes`` bytes or more, is as
    old as ``max_age_ms`` (by the records' times), or the record doesn't follow its last. The last segment is the open one.
    """
    return greedy_runs(log, max_records, max_bytes, max_age_ms, gaps=True).withColumnRenamed("run", "segment")


def dead_segments(segments: DataFrame, live: DataFrame, size: int) -> DataFrame:
    """Segments (topic, segment = (seq - 1) div size) of which no record lives."""
    held = live.select("topic", F.expr(f"(seq - 1) DIV {size}").alias("segment")).distinct()
    return segments.join(held, ["topic", "segment"], "left_anti")
