"""Work queues: leases are a fold of an append-only table of lease events.

lease_events: pos, seq, event (claimed, released, extended, acked), node, lease_id, deadline_ms, ready_at_ms, ts_ms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..errors import LedgerError
from .append import assign_seq, idempotent_writes
from ..functions.exprs import record_bytes


def lease_fold(events: DataFrame, now_ms: int) -> DataFrame:
    """One row for each seq ever claimed: lease_id, node, deadline_ms, leased, acked, deliveries, ready_at_ms.

    The last claim counts; it ends with a release or ack of the same lease id, moves with its extensions, and expires when now is past the
    deadline. Deliveries are claims since the last ack. Events of stale leases have no effect.
    """
    own = ["connection"] if "connection" in events.columns else []
    was = lambda event, c: F.when(F.col("event") == event, F.col(c))
    # one shuffle by seq serves both levels
    each = events.repartition("seq").groupBy("seq", "lease_id").agg(
        F.max(was("claimed", "pos")).alias("claim_pos"), F.max_by(F.struct("node", "deadline_ms", *own), was("claimed", "pos")).alias("c"), F.collect_list(was("claimed", "pos")).alias("claims"),
        F.max(was("acked", "pos")).alias("ack_pos"), F.count(was("released", "pos")).alias("released"), F.count(was("acked", "pos")).alias("acked"),
        F.max_by("deadline_ms", was("extended", "pos")).alias("extended"), F.max(was("released", "ready_at_ms")).alias("ready_at_ms"))
    last = F.max_by(F.struct("lease_id", "c.node", F.col("c.deadline_ms").alias("until"), *[f"c.{x}" for x in own], "released", "acked", "extended", "ready_at_ms"), "claim_pos").alias("l")
    out = each.groupBy("seq").agg(last, F.max("ack_pos").alias("ack_pos"), F.flatten(F.collect_list("claims")).alias("claims")).where("l IS NOT NULL")
    out = out.select("seq", "l.*", F.expr("CAST(size(filter(claims, p -> p > coalesce(ack_pos, -1))) AS BIGINT)").alias("deliveries"))
    deadline = F.coalesce("extended", "until")
    held = (F.col("released") == 0) & (F.col("acked") == 0) & (F.lit(now_ms) <= deadline)
    return out.select("seq", "lease_id", "node", deadline.alias("deadline_ms"), held.alias("leased"), (F.col("acked") > 0).alias("acked"), "deliveries", "ready_at_ms", *own)


def claimable(queue: DataFrame, leases: DataFrame, now_ms: int) -> DataFrame:
    """Live records that nobody holds and no delay holds back, with their deliveries."""
    held = leases.select("seq", "leased", "acked", "deliveries", "ready_at_ms")
    rows = queue.join(held, "seq", "left").where("NOT coalesce(leased, false) AND NOT coalesce(acked, false)")
    return rows.where((F.col("ready_at_ms").isNull()) | (F.col("ready_at_ms") <= now_ms)).withColumn("deliveries", F.coalesce("deliveries", F.lit(0)).cast("long")).drop("leased", "acked", "ready_at_ms")


def dead_letters(ready: DataFrame, max_deliveries: int) -> DataFrame:
    """Records that the next claim diverts: they were delivered as often as they may be."""
    return ready.where(F.lit(max_deliveries > 0) & (F.col("deliveries") + 1 > max_deliveries))


#: The keys under which a dead letter says where it comes from.
PROVENANCE = ("$dead_letter_deliveries", "$dead_letter_from", "$dead_letter_src_seq")


def divert(dead: DataFrame, source: str, dest: str, dest_head: int, now_ms: int, max_deliveries: int) -> DataFrame:
    """Copies for the dead-letter log: where they come from is merged into the record's own meta (an object; else it is replaced).

    Keys of meta are in order of their names. Bytes are those of data and the new meta.
    """
    own = F.from_json(F.col("meta"), "map<string,variant>") if "meta" in dead.columns else F.lit(None).cast("map<string,variant>")
    says = {PROVENANCE[0]: F.lit(str(max_deliveries)), PROVENANCE[1]: F.lit(source), PROVENANCE[2]: F.col("seq").cast("string")}
    add = F.create_map(*[x for k, v in says.items() for x in (F.lit(k), v.cast("variant"))])
    kept = F.map_filter(F.coalesce(own, F.create_map().cast("map<string,variant>")), lambda k, _: ~k.isin(*PROVENANCE))
    rows = dead.withColumn("_meta", F.map_concat(kept, add)).withColumn("_keys", F.array_sort(F.map_keys("_meta")))
    rows = rows.withColumn("meta", F.expr("to_json(map_from_arrays(_keys, transform(_keys, k -> _meta[k])))")).drop("_meta", "_keys")
    rows = rows.withColumn("bytes", record_bytes("data", "meta"))
    rows = assign_seq(rows.withColumn("topic", F.lit(dest)).withColumnRenamed("seq", "source_seq"), ["topic"], ["source_seq"])
    return rows.select("topic", (F.col("seq") + dest_head).alias("seq"), F.lit(now_ms).alias("ts_ms"), "node", "tag", "data", "meta", "bytes", "source_seq")


def cohort(ready: DataFrame, claimers: DataFrame, first_lease: int, now_ms: int) -> DataFrame:
    """Divide the lowest ready records among claimers round robin, each up to its max: (seq, node, lease_id, deadline_ms).

    ``claimers``: ord (order of arrival), node, max, lease_ms. Slots (k-th turn of each claimer) and records are
    numbered and joined on the number. No more records are read than there are slots.
    """
    limited = claimers.withColumn("max", F.least("max", F.lit(C.CLAIM_MAX))).where("max > 0")
    slots = limited.select("ord", "node", "lease_ms", F.explode(F.sequence(F.lit(1), F.col("max"))).alias("k"))
    slots = slots.withColumn("slot", F.row_number().over(Window.orderBy("k", "ord")))  # claim requests: at most CLAIM_MAX slots each
    wanted = limited.agg(F.coalesce(F.sum("max"), F.lit(0))).first()[0]
    jobs = ready.select("seq").orderBy("seq").limit(int(wanted)).withColumn("slot", F.row_number().over(Window.orderBy("seq")))
    lease = F.greatest(F.lit(C.LEASE_MS_MIN), F.least(F.lit(C.LEASE_MS_MAX), F.col("lease_ms")))
    out = jobs.join(slots, "slot")
    return out.select("seq", "node", (F.lit(first_lease - 1) + F.col("slot")).cast("long").alias("lease_id"), (F.lit(now_ms) + lease).cast("long").alias("deadline_ms"))


def claim_windows(claims: DataFrame, jitter_ms: int) -> DataFrame:
    """(topic, pos, at_ms, leader, served_ms): which claims are served in one pass (``claims``: topic, pos in order of arrival, at_ms).

    The first claim leads and waits ``jitter_ms``; those that come before its wait is over join it; the next leads anew. Without a wait each is alone.
    """
    wait = max(0, min(jitter_ms, C.JITTER_MS_MAX))
    if not wait:
        return claims.select("topic", "pos", "at_ms", F.col("pos").alias("leader"), F.col("at_ms").alias("served_ms"))
    led = idempotent_writes(claims.select("pos", F.col("topic").alias("idem_key"), F.col("at_ms").alias("ts_ms")), wait - 1)
    first = led.where("accepted").select(F.col("pos").alias("leader"), (F.col("ts_ms") + wait).alias("served_ms"))
    return led.select(F.col("idem_key").alias("topic"), "pos", F.col("ts_ms").alias("at_ms"), F.col("original_pos").alias("leader")).join(first, "leader").select("topic", "pos", "at_ms", "leader", "served_ms")


def release_connection(leases: DataFrame, connection: str, now_ms: int) -> DataFrame:
    """Lease events that give back, at once, what a connection that is gone still holds."""
    held = leases.where(F.col("leased") & (F.col("connection") == connection)).withColumn("done", F.lit(True)).withColumn("held_id", F.col("lease_id"))
    return _events(held, "released", now_ms, F.lit(None).cast("long"), F.lit(None).cast("long"))


def claim(ready: DataFrame, node: str, most: int, lease_ms: int, first_lease: int, now_ms: int) -> DataFrame:
    """One claimer: a cohort of one."""
    one = ready.sparkSession.createDataFrame([(0, node, most, lease_ms)], "ord int, node string, max int, lease_ms long")
    return cohort(ready, one, first_lease, now_ms)


def fenced(leases: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (seq, node, lease_id or null) with done: does the asker hold a lease that has not expired? Ack, nack and extend share it."""
    held = leases.where("leased").select("seq", F.col("node").alias("holder"), F.col("lease_id").alias("held_id"), F.lit(True).alias("held"))
    out = asked.join(held, "seq", "left")
    ok = F.coalesce(F.col("held"), F.lit(False)) & (F.col("holder") == F.col("node")) & (F.col("lease_id").isNull() | (F.col("lease_id") == F.col("held_id")))
    return out.select("seq", "node", "lease_id", F.coalesce(ok, F.lit(False)).alias("done"), "held_id")


def ack(leases: DataFrame, asked: DataFrame, now_ms: int) -> DataFrame:
    """Lease events of the acks that hold."""
    return _events(fenced(leases, asked), "acked", now_ms, F.lit(None).cast("long"), F.lit(None).cast("long"))


def nack(leases: DataFrame, asked: DataFrame, delay_ms: int, now_ms: int) -> DataFrame:
    delay = max(0, min(delay_ms, C.NACK_DELAY_MAX))
    return _events(fenced(leases, asked), "released", now_ms, F.lit(None).cast("long"), F.lit(now_ms + delay if delay else None).cast("long"))


def extend(leases: DataFrame, asked: DataFrame, lease_ms: int, now_ms: int) -> DataFrame:
    lease = max(C.LEASE_MS_MIN, min(lease_ms, C.LEASE_MS_MAX))
    return _events(fenced(leases, asked), "extended", now_ms, F.lit(now_ms + lease).cast("long"), F.lit(None).cast("long"))


def _events(found: DataFrame, event: str, now_ms: int, deadline, ready_at) -> DataFrame:
    return found.where("done").select("seq", F.lit(event).alias("event"), "node", F.col("held_id").alias("lease_id"), deadline.alias("deadline_ms"), ready_at.alias("ready_at_ms"), F.lit(now_ms).cast("long").alias("ts_ms"))


def counters(queue: DataFrame, leases: DataFrame, now_ms: int, dead_lettered: int = 0) -> DataFrame:
    """One row: live, ready, in_flight, delayed, dead_lettered (which the queue's own count says)."""
    rows = queue.select("seq").join(leases, "seq", "left").where("NOT coalesce(acked, false)")
    flying = F.coalesce("leased", F.lit(False))
    delayed = ~flying & F.coalesce(F.col("ready_at_ms") > now_ms, F.lit(False))
    n = lambda c: F.count(F.when(c, 1))
    return rows.agg(F.count("*").alias("live"), n(~flying & ~delayed).alias("ready"), n(flying).alias("in_flight"), n(delayed).alias("delayed")).withColumn("dead_lettered", F.lit(dead_lettered).cast("long"))


def check_arrays(seqs: int, lease_ids: int | None = None) -> None:
    """Bounds of an ack, nack or extend, by the numbers of its seqs and lease ids."""
    if seqs > C.CLAIM_MAX:
        raise LedgerError("invalid_request", f"at most {C.CLAIM_MAX} seqs")
    if lease_ids is not None and lease_ids != seqs:
        raise LedgerError("invalid_request", "as many lease_ids as seqs")

