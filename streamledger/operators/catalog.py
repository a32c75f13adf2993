"""Catalog operators: topic configs, state, lists, cascades, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..errors import LedgerError
from ..functions.exprs import allowed, check_name, token_column


def normalize_config(config: dict, existing: dict | None = None) -> dict:
    """A whole config with defaults for what is left out (a put replaces, it doesn't merge); the type can't change."""
    unknown = set(config) - set(C.TOPIC_DEFAULTS)
    if unknown:
        raise LedgerError("invalid_request", f"no such setting: {sorted(unknown)}")
    out = C.TOPIC_DEFAULTS | config
    if out["type"] not in ("log", "queue") or out["discard"] not in ("old", "reject"):
        raise LedgerError("invalid_request", "type is log or queue, discard is old or reject")
    if any(out[k] < 0 for k in ("ttl_ms", "cap_records", "cap_bytes", "max_deliveries", "idempotency_window_ms")):
        raise LedgerError("invalid_request", "limits are 0 (off) or positive")
    if existing and existing["type"] != out["type"]:
        raise LedgerError("topic_exists_incompatible", "the type of a topic can't change")
    if out["priority"] is not None:
        out["priority"] = max(C.PRIORITY_MIN, min(C.PRIORITY_MAX, out["priority"]))
    if out["durability"] not in (None, *C.DURABILITY):
        raise LedgerError("invalid_request", f"durability is one of {', '.join(C.DURABILITY)}")
    out["durability"] = out["durability"] or ("fsync" if out["durable"] else "disk")  # what is named wins over durable
    out["durable"] = out["durability"] == "fsync"
    out["lease_ms"] = max(C.LEASE_MS_MIN, min(C.LEASE_MS_MAX, out["lease_ms"]))
    out["claim_jitter_ms"] = min(out["claim_jitter_ms"], C.JITTER_MS_MAX)
    if out["dead_letter"] is not None:
        check_name(out["dead_letter"])
    return out


def latest(catalog: DataFrame, key: str = "name") -> DataFrame:
    """The catalog's last row for each key, without keys whose last row is a deletion."""
    rest = [c for c in catalog.columns if c not in (key,)]
    rows = catalog.groupBy(key).agg(F.max_by(F.struct(*rest), "pos").alias("r")).select(key, "r.*")
    return rows.where("NOT coalesce(deleted, false)") if "deleted" in rest else rows


def topic_state(log: DataFrame) -> DataFrame:
    """One row a topic: count, bytes, earliest_seq, head, first_ts_ms, last_ts_ms."""
    return log.groupBy("topic").agg(F.count("*").alias("count"), F.sum("bytes").cast("long").alias("bytes"), F.min("seq").alias("earliest_seq"), F.max("seq").alias("head"), F.min("ts_ms").alias("first_ts_ms"), F.max("ts_ms").alias("last_ts_ms"))


def list_page(names: DataFrame, after: str = "", prefix: str = "", limit: int = 0, prefixes=()) -> DataFrame:
    """A page of names in order after the cursor, each with more (another page follows) and the cursor that would follow it."""
    n = min(limit or C.PAGE_LIMIT, C.PAGE_LIMIT_MAX)
    rows = names.where((F.col("name") > after) & F.col("name").startswith(prefix) & allowed(prefixes))
    rows = rows.orderBy("name").limit(n + 1)
    total = rows.count()  # at most a page
    page = rows.orderBy("name").limit(n)
    return page.withColumn("more", F.lit(total > n)).withColumn("cursor", token_column(F.col("name")))


def delete_cascade(routers: DataFrame, dropped: DataFrame) -> DataFrame:
    """Routers that go with the ``dropped`` logs (topic): those that start or end there."""
    a = routers.join(dropped, routers.source == dropped.topic, "left_semi")
    b = routers.join(dropped, routers.dest == dropped.topic, "left_semi")
    return a.union(b).distinct()


def list_routers(routers: DataFrame, source: str | None = None, dest: str | None = None, prefix: str = "", after: str = "", limit: int = 0) -> DataFrame:
    """A page of routers (name, source, dest) in order of name."""
    rows = routers.where((F.col("name") > after) & F.col("name").startswith(prefix))
    for c, wanted in (("source", source), ("dest", dest)):
        rows = rows.where(F.col(c) == wanted) if wanted is not None else rows
    return rows.orderBy("name").limit(min(limit or C.PAGE_LIMIT, C.PAGE_LIMIT_MAX))


def check_delete(count: int, if_empty: bool) -> None:
    if if_empty and count:
        raise LedgerError("topic_not_empty", f"{count} records")


def metrics_by_class(log: DataFrame, configs: DataFrame) -> DataFrame:
    """Logs, records and bytes by class (``configs``: topic, class)."""
    per = log.groupBy("topic").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
    rows = configs.join(per, "topic", "left")
    return rows.groupBy("class").agg(F.count("*").alias("logs"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("records"), F.coalesce(F.sum("b"), F.lit(0)).cast("long").alias("bytes"))


def latency_histogram(observed: DataFrame, column: str) -> DataFrame:
    """Cumulative counts at or below each bound, and in all (bound null)."""
    bounds = [*C.FSYNC_BUCKETS_US]
    counts = observed.agg(*[F.count(F.when(F.col(column) <= b, 1)).alias(f"le_{b}") for b in bounds], F.count(column).alias("total"), F.coalesce(F.sum(column), F.lit(0)).cast("long").alias("sum_us"))
    stack = ", ".join([f"{b}L, le_{b}" for b in bounds] + ["NULL, total"])
    return counts.selectExpr(f"stack({len(bounds) + 1}, {stack}) AS (le_us, observations)", "sum_us")


def quota(log: DataFrame, max_total_bytes: int) -> DataFrame:
    """One row: bytes held, and whether they are within the quota (0: off)."""
    held = F.coalesce(F.sum("bytes"), F.lit(0)).cast("long")
    return log.agg(held.alias("bytes")).withColumn("within", F.lit(max_total_bytes == 0) | (F.col("bytes") <= max_total_bytes))
