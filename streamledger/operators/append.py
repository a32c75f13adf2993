"""Append: limits, default node, sequence numbers, admission, idempotent writes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.exprs import record_bytes

BLOCK = 1 << 16


def prefix_sums(rows: DataFrame, by: list[str], order: str, value: str | None, name: str, descending: bool = False, also: dict[str, str] | None = None) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` (None: the number of rows) up to and with each row, by the long ``order``. ``also`` names sums of more columns.

    Two levels: sums of blocks of ``order`` (aggregated before they move), a running sum over the blocks, and a window
    inside each block. So one huge log is many windows. ``order`` has to be unique within ``by``. All sums are taken in one call.
    """
    sums = {name: value, **(also or {})}
    of = lambda c: F.lit(1).cast("long") if c is None else F.col(c)
    turn = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    blocked = rows.withColumn("_block", F.expr(f"{order} DIV {BLOCK}"))
    totals = blocked.groupBy(*by, "_block").agg(*[F.sum(of(c)).alias(f"_sum_{n}") for n, c in sums.items()])
    ahead = Window.partitionBy(*by).orderBy(turn("_block")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "_block", *[F.coalesce(F.sum(f"_sum_{n}").over(ahead), F.lit(0)).alias(f"_before_{n}") for n in sums])
    inside = Window.partitionBy(*by, "_block").orderBy(turn(order)).rowsBetween(Window.unboundedPreceding, 0)
    out = blocked.join(totals, [*by, "_block"])
    out = out.withColumns({f"_in_{n}": F.col(f"_before_{n}") + F.sum(of(c)).over(inside) for n, c in sums.items()})
    return out.drop("_block", *sums, *[f"_before_{n}" for n in sums]).withColumnsRenamed({f"_in_{n}": n for n in sums})


def assign_seq(batch: DataFrame, topic: list[str], order: list[str], heads: DataFrame | None = None, also: dict[str, str] | None = None) -> DataFrame:
    """Contiguous numbers per topic, after the topic's head (``heads``: topic columns and head; default 0).

    Numbered in two levels, so that a topic with most of the batch is no single window: by blocks of a single long order column, else
    by ranges of all order columns, written once so that both levels see the same ranges. ``also`` names running
    sums of columns to take along.
    """
    if len(order) == 1 and dict(batch.dtypes)[order[0]] in ("bigint", "int"):
        numbered = prefix_sums(batch, topic, order[0], None, "seq", also=also)
    else:
        from ..sources.tables import written

        ranged = written(batch.repartitionByRange(*topic, *order).withColumn("_range", F.spark_partition_id()), "ranges")
        counts = ranged.groupBy(*topic, "_range").agg(F.count("*").alias("_n"))
        ahead = Window.partitionBy(*topic).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
        inside = Window.partitionBy(*topic, "_range").orderBy(*order)
        numbered = ranged.join(counts, [*topic, "_range"]).withColumn("seq", (F.col("_before") + F.row_number().over(inside)).cast("long")).drop("_range", "_before")
    if heads is None:
        return numbered
    return numbered.join(heads, topic, "left").withColumn("seq", F.col("seq") + F.coalesce("head", F.lit(0))).drop("head")


def prepared(batch: DataFrame, node: str | None = None) -> DataFrame:
    """Records with the batch's node where they have none, their bytes, and the first limit they break (``problem``, else null)."""
    has = set(batch.columns)
    size = record_bytes("data", "meta" if "meta" in has else None)
    rows = batch.withColumn("node", F.coalesce("node", F.lit(node).cast("string"))).withColumn("bytes", size)
    problem = F.when(F.octet_length("tag") > C.MAX_TAG_BYTES, "tag").when(F.octet_length("node") > C.MAX_NODE_BYTES, "node")
    if "meta" in has:
        problem = problem.when(F.octet_length("meta") > C.MAX_META_BYTES, "meta").when(F.size(F.json_object_keys("meta")) > C.MAX_META_KEYS, "meta_keys")
    return rows.withColumn("problem", problem.when(F.col("bytes") > C.MAX_RECORD_BYTES, "record"))


def admission(current: DataFrame, batch: DataFrame, cap_records: int, cap_bytes: int) -> DataFrame:
    """One row: would a log that rejects take the batch? outcome: admit, topic_full, or record_too_large (over the whole cap)."""
    have = current.agg(F.count("*").alias("count"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"))
    more = batch.agg(F.count("*").alias("batch_count"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("batch_bytes"))
    over = lambda n, cap: F.lit(cap > 0) & (n > cap)
    whole = over(F.col("batch_count"), cap_records) | over(F.col("batch_bytes"), cap_bytes)
    full = over(F.col("count") + F.col("batch_count"), cap_records) | over(F.col("bytes") + F.col("batch_bytes"), cap_bytes)
    return have.crossJoin(more).withColumn("outcome", F.when(whole, "record_too_large").when(full, "topic_full").otherwise("admit"))


def _past(ts: np.ndarray, a: int, b: int, limit: int) -> int:
    """The first place from a to b whose time is past the limit, else b; times need no order, and a far place is found in steps that double."""
    step = 16
    while a < b:
        hit = np.flatnonzero(ts[a : min(b, a + step)] > limit)
        if len(hit):
            return a + int(hit[0])
        a, step = a + step, 2 * step
    return b


def idempotent_writes(writes: DataFrame, window_ms: int) -> DataFrame:
    """(pos, idem_key, ts_ms, accepted, original_pos) of every write in order of pos.

    A key's first write opens a window; writes of the key within it (now - created <= window) answer with the
    first one's result and don't extend it; the next opens a new one. Null keys are always accepted. Keys are hashed to
    partitions, sorted there, and read as a stream with the state of one key, so a hot key costs time but no memory.
    """
    rows = writes.select("pos", "idem_key", "ts_ms").repartition("idem_key").sortWithinPartitions("idem_key", "pos")

    def run(batches):
        key, created, first = None, 0, 0
        for t in batches:
            keys, pos, ts = t.column("idem_key"), t.column("pos").to_numpy(), t.column("ts_ms").to_numpy()
            codes = keys.dictionary_encode().indices.to_numpy()
            edges = np.flatnonzero(np.diff(codes, prepend=-1))
            accepted, original = np.zeros(len(pos), bool), np.empty(len(pos), np.int64)
            for a, b in zip(edges, np.append(edges[1:], len(pos)), strict=True):
                if keys[a].as_py() != key:
                    key, at = keys[a].as_py(), a
                else:  # the key goes on from the batch before
                    at = _past(ts, a, b, created + window_ms)
                    original[a:at] = first
                while at < b:
                    accepted[at], created, first = True, int(ts[at]), int(pos[at])
                    end = _past(ts, at + 1, b, created + window_ms)
                    original[at:end] = first
                    at = end
            yield pa.RecordBatch.from_arrays([t.column("pos"), keys, t.column("ts_ms"), pa.array(accepted), pa.array(original)], ["pos", "idem_key", "ts_ms", "accepted", "original_pos"])

    keyed = rows.where("idem_key IS NOT NULL").mapInArrow(run, "pos long, idem_key string, ts_ms long, accepted boolean, original_pos long")
    free = writes.where("idem_key IS NULL").select("pos", F.col("idem_key").cast("string").alias("idem_key"), "ts_ms", F.lit(True).alias("accepted"), F.col("pos").alias("original_pos"))
    return keyed.union(free)
