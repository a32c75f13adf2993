"""Routers: forwarding between logs as filter, projection and fresh numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..errors import LedgerError
from ..functions.exprs import TagFilter
from .append import assign_seq


def forward_window(source: DataFrame, cursor: int, head: int, batch: int = C.ROUTER_BATCH) -> DataFrame:
    """The next records a router looks at: (cursor, min(head, cursor + batch)]."""
    return source.where((F.col("seq") > cursor) & (F.col("seq") <= min(head, cursor + batch)))


def pending(source: DataFrame, cursor: int) -> DataFrame:
    """All that a router has still to look at, (cursor, head]: what ``forward_window`` gives pass after pass until the head."""
    return source.where(F.col("seq") > cursor)


def forward(source: DataFrame, dest: str, dest_head: int, now_ms: int, match=None, preserve_node: bool = True, preserve_tag: bool = True, dest_keys: DataFrame | None = None, router: str = "", room_records: int | None = None, room_bytes: int | None = None) -> DataFrame:
    """Records as they arrive in ``dest``: filtered, below the hop cap, numbered after its head, stamped with ``now_ms``.

    ``room_records`` and ``room_bytes`` bound what a destination that rejects takes: the longest prefix that fits. With ``dest_keys`` (column source_key of what dest retains) delivery is exactly once: what is there is skipped.
    """
    rows = source if "hops" in source.columns else source.withColumn("hops", F.lit(0))
    rows = rows.where(F.col("hops") < C.MAX_HOPS)
    if match is not None:
        rows = rows.where(TagFilter.parse(match).column())
    rows = rows.withColumn("source_key", F.concat_ws(":", F.lit(router), "topic", F.col("seq").cast("string")))
    if dest_keys is not None:
        rows = rows.join(dest_keys.select("source_key"), "source_key", "left_anti")
    rows = rows.withColumn("source_seq", F.col("seq")).withColumn("topic", F.lit(dest)).drop("seq")
    rows = assign_seq(rows, ["topic"], ["source_seq"], also={"_held": "bytes"} if room_bytes is not None else None)
    if room_records is not None:
        rows = rows.where(F.col("seq") <= room_records)
    if room_bytes is not None:
        rows = rows.where(F.col("_held") <= room_bytes)
    rows = rows.withColumn("seq", F.col("seq") + dest_head)
    node = F.col("node") if preserve_node else F.lit(None).cast("string")
    tag = F.col("tag") if preserve_tag else F.lit(None).cast("string")
    return rows.select("topic", "seq", F.lit(now_ms).cast("long").alias("ts_ms"), node.alias("node"), tag.alias("tag"), "data", *(["meta"] if "meta" in rows.columns else []), "bytes", (F.col("hops") + 1).alias("hops"), "source_seq", "source_key")


def source_trim(cursors: DataFrame, state: DataFrame) -> DataFrame:
    """(topic, first, last, holes): records that left a source before they were forwarded, so the destination's source_trim floor.

    ``cursors`` has topic and cursor (the last record forwarded), ``state`` topic and earliest_seq of the source.
    """
    rows = cursors.join(state.select("topic", "earliest_seq"), "topic").where("earliest_seq - 1 > cursor")
    return rows.select("topic", (F.col("cursor") + 1).alias("first"), (F.col("earliest_seq") - 1).alias("last"), (F.col("earliest_seq") - 1 - F.col("cursor")).alias("holes"))


def hop_closure(seeds: DataFrame, routers: DataFrame, max_hops: int = C.MAX_HOPS) -> DataFrame:
    """(topic, hops, records): how many copies a set of records makes along ``routers`` (source, dest) before the hop cap stops them.

    ``seeds`` has topic and records. The fixpoint is at most ``max_hops`` joins on the small edge list.
    """
    level = seeds.select("topic", F.lit(0).alias("hops"), "records")
    out = level
    edges = routers.select("source", "dest").distinct()
    for _ in range(max_hops):
        level = level.join(edges, F.col("topic") == F.col("source")).groupBy("dest").agg(F.sum("records").alias("records"), F.max("hops").alias("h"))
        level = level.select(F.col("dest").alias("topic"), (F.col("h") + 1).alias("hops"), "records")
        out = out.union(level)
    return out.where("records > 0")


def reachable(routers: DataFrame) -> DataFrame:
    """(source, dest) pairs connected by routers, over any number of hops.

    Semi-naive: each round joins the pairs found last with the edges and keeps those not known, until there are none. Pairs
    are distinct, so branches and cycles cost no more than the pairs there are.
    """
    from ..sources.tables import written

    edges = written(routers.select("source", "dest").distinct(), "edges")
    onward = edges.select(F.col("source").alias("dest"), F.col("dest").alias("next"))
    out = fresh = edges
    while not fresh.isEmpty():
        step = fresh.join(onward, "dest").select("source", F.col("next").alias("dest")).distinct()
        fresh = written(step.join(out, ["source", "dest"], "left_anti"), "pairs")
        out = out.union(fresh)
    return out


def check_cycle(edges: list[tuple[str, str]], source: str, dest: str, allow: bool = False) -> None:
    """Refuse a router whose destination already reaches its source; the error carries the path. A catalog is small: driver code."""
    back: dict[str, str | None] = {dest: None}
    queue = [dest]
    while queue:
        at = queue.pop(0)
        if at == source:
            path = [at]
            while back[path[-1]] is not None:
                path.append(back[path[-1]])
            if not allow:
                raise LedgerError("router_cycle", f"{dest} reaches {source}", path=path[::-1])
            return
        for a, b in edges:
            if a == at and b not in back:
                back[b] = at
                queue.append(b)


def drain_order(sources: DataFrame) -> DataFrame:
    """Dirty sources by band (highest first), then as they came: (topic, band, enqueued_ms, turn)."""
    order = Window.orderBy(F.desc("band"), "enqueued_ms", "topic")  # a row for each source with work
    return sources.withColumn("turn", F.row_number().over(order))
