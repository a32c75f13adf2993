"""Cursor reads: page, next cursor, lag, multi-topic watch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..errors import LedgerError
from ..functions.exprs import byte_limit, decision, row_limit
from .runs import greedy_runs


def decisions(log: DataFrame, now_ms: int, ttl_ms: int = 0, nodes=(), deleted_below: int = 0) -> DataFrame:
    return log.withColumn("decision", decision(ttl_ms, now_ms, nodes, F.col("seq") < deleted_below))


def _page(log: DataFrame, from_seq: int, limit: int, max_bytes: int, now_ms: int, ttl_ms: int, nodes, deleted_below: int) -> DataFrame:
    """Candidates of one log: the first ``limit`` + 1 deliverable rows (a bounded top-k), with row number and running bytes."""
    n = row_limit(limit)
    rows = decisions(log.where(F.col("seq") > from_seq), now_ms, ttl_ms, nodes, deleted_below).where("decision = 'deliver'").drop("decision")
    rows = rows.orderBy("seq").limit(n + 1)
    order = Window.partitionBy("topic").orderBy("seq")
    rows = rows.withColumn("rn", F.row_number().over(order)).withColumn("cum", F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("in_page", (F.col("rn") <= n) & ((F.col("rn") == 1) | (F.col("cum") <= byte_limit(max_bytes))))


def diff_page(log: DataFrame, from_seq: int = 0, limit: int = 0, max_bytes: int = 0, now_ms: int = 0, ttl_ms: int = 0, nodes=(), deleted_below: int = 0, tags: bool = False, meta: bool = True) -> DataFrame:
    """Records after the cursor in order, at most ``limit`` rows and ``max_bytes`` (the first is always delivered)."""
    page = _page(log, from_seq, limit, max_bytes, now_ms, ttl_ms, nodes, deleted_below).where("in_page")
    keep = ["topic", "seq", "ts_ms", "node", *(["tag"] if tags else []), "data", *(["meta"] if meta and "meta" in log.columns else []), "bytes"]
    return page.select(*keep)


def diff_cursor(log: DataFrame, from_seq: int = 0, limit: int = 0, max_bytes: int = 0, now_ms: int = 0, ttl_ms: int = 0, nodes=(), deleted_below: int = 0, head: DataFrame | None = None) -> DataFrame:
    """One row: records, next_from_seq, head, caught_up, lag.

    A full page ends at its last record; a page cut by bytes just before the first record left out; else the head
    is reached, and what was skipped is behind the cursor. ``head`` (one row) says where the log ends, so that ``log`` need not hold what is
    before the cursor.
    """
    n = row_limit(limit)
    page = _page(log, from_seq, limit, max_bytes, now_ms, ttl_ms, nodes, deleted_below)
    facts = page.agg(F.count(F.when(F.col("in_page"), 1)).alias("records"), F.max(F.when(F.col("in_page"), F.col("seq"))).alias("last"), F.min(F.when(~F.col("in_page"), F.col("seq"))).alias("cut"))
    head = log.agg(F.coalesce(F.max("seq"), F.lit(0)).cast("long").alias("head")) if head is None else head
    both = facts.crossJoin(head)
    after = F.when(F.col("records") == n, F.col("last")).when(F.col("cut").isNotNull(), F.col("cut") - 1).otherwise(F.greatest("head", F.lit(from_seq)))
    return both.withColumn("next_from_seq", after.cast("long")).select("records", "next_from_seq", "head", (F.col("next_from_seq") == F.col("head")).alias("caught_up"), (F.col("head") - F.col("next_from_seq")).alias("lag"))


def watch_batch(logs: DataFrame, cursors: DataFrame, limit: int = 0, nodes=()) -> DataFrame:
    """The first ``limit`` records after each topic's cursor (``cursors``: topic, from_seq). Logs without records yield none."""
    n = row_limit(limit)
    rows = logs.join(cursors, "topic").where(F.col("seq") > F.col("from_seq"))
    rows = rows.where(decision(0, 0, nodes) == "deliver")
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("topic").orderBy("seq"))).where(F.col("rn") <= n).drop("rn", "from_seq")


def watch_cursors(logs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Start positions: ``wanted`` has topic, from_seq, tail; a tail starts at the head, unknown logs are dropped."""
    heads = logs.groupBy("topic").agg(F.max("seq").alias("head"))
    return wanted.join(heads, "topic").select("topic", F.when(F.col("tail"), F.col("head")).otherwise(F.coalesce("from_seq", F.lit(0))).cast("long").alias("from_seq"))


def rewind(session: DataFrame, client: DataFrame) -> DataFrame:
    """A client's positions may only move a session's back."""
    c = client.select("topic", F.col("from_seq").alias("asked"))
    return session.join(c, "topic", "left").select("topic", F.least("from_seq", F.coalesce("asked", "from_seq")).alias("from_seq"))


def watch_frames(logs: DataFrame, cursors: DataFrame, nodes=(), evicted: DataFrame | None = None) -> DataFrame:
    """(topic, ord, kind, seq) of a watch that drains every log to its head.

    A tombstone first where the cursor is below what was lost (``evicted``: topic, evict_earliest), then the records after both, then
    caught_up with the true head, once, even if no record passed. A watched name without a log gets topic_deleted and nothing else.
    """
    heads = logs.groupBy("topic").agg(F.max("seq").alias("head"))
    state = cursors.select("topic", "from_seq").join(heads, "topic", "left")
    gone = state.where("head IS NULL").select("topic", F.lit(0).alias("ord"), F.lit("topic_deleted").alias("kind"), F.lit(0).cast("long").alias("seq"))
    state = state.where("head IS NOT NULL").withColumn("start", F.col("from_seq"))
    out = gone
    if evicted is not None:
        state = state.join(evicted.select("topic", "evict_earliest"), "topic", "left")
        lost = F.col("from_seq") + 1 < F.col("evict_earliest")
        state = state.withColumn("start", F.when(lost, F.col("evict_earliest") - 1).otherwise(F.col("from_seq")))
        out = out.union(state.where(lost).select("topic", F.lit(0).alias("ord"), F.lit("tombstone").alias("kind"), "start"))
    rows = logs.join(state.select("topic", "start"), "topic").where(F.col("seq") > F.col("start")).where(decision(0, 0, nodes) == "deliver")
    out = out.union(rows.select("topic", F.lit(1).alias("ord"), F.lit("record").alias("kind"), "seq"))
    return out.union(state.select("topic", F.lit(2).alias("ord"), F.lit("caught_up").alias("kind"), "head"))


def watch_batches(logs: DataFrame, cursors: DataFrame, limit: int = 0, max_bytes: int = 0, nodes=()) -> DataFrame:
    """(topic, frame, from_seq, to_seq, head, records, bytes): the record frames in which a watch drains its logs.

    Each holds at most ``limit`` records and ``max_bytes`` bytes (its first record always fits). A frame starts at the cursor that the one
    before left; the last leaves it at the head, behind what was filtered.
    """
    check_watch(cursors.count())
    heads = logs.groupBy("topic").agg(F.max("seq").alias("head"))
    rows = logs.join(cursors.select("topic", "from_seq"), "topic").where(F.col("seq") > F.col("from_seq")).where(decision(0, 0, nodes) == "deliver")
    runs = greedy_runs(rows, row_limit(limit), byte_limit(max_bytes), fit=True)
    turn = Window.partitionBy("topic").orderBy("run")  # a row for each frame
    runs = runs.withColumn("left_at", F.lag("last_seq").over(turn)).withColumn("next_run", F.lead("run").over(turn)).join(heads, "topic").join(cursors.select("topic", "from_seq"), "topic")
    start, stop = F.coalesce("left_at", "from_seq"), F.when(F.col("next_run").isNull(), F.col("head")).otherwise(F.col("last_seq"))
    return runs.select("topic", F.col("run").alias("frame"), start.alias("from_seq"), stop.alias("to_seq"), "head", "records", "bytes")


def next_cursors(logs: DataFrame, cursors: DataFrame) -> DataFrame:
    """(topic, from_seq): where a drained watch stands, at each log's head; names without a log are gone."""
    heads = logs.groupBy("topic").agg(F.max("seq").alias("head"))
    return cursors.select("topic", "from_seq").join(heads, "topic").select("topic", F.greatest("from_seq", "head").alias("from_seq"))


def idle_sessions(sessions: DataFrame, now_ms: int) -> DataFrame:
    """Watch sessions that have had no stream for longer than they may (``sessions``: session, streams, idle_since_ms)."""
    return sessions.where((F.col("streams") == 0) & (F.lit(now_ms) - F.col("idle_since_ms") > C.SESSION_IDLE_MS))


def check_watch(logs: int) -> None:
    if logs > C.MAX_WATCH_LOGS:
        raise LedgerError("invalid_request", f"at most {C.MAX_WATCH_LOGS} logs")
