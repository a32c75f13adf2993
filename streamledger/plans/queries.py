"""Named queries over the driver's tables, each with DuckDB SQL for the same rows.

Times are fixed: NOW is after the last event, so that no query depends on a clock.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import append as A
from ..operators import bodies as B
from ..operators import catalog as K
from ..operators import delete as D
from ..operators import queue as Q
from ..operators import read as R
from ..operators import retention as T
from ..operators import router as O
from ..operators import socket as S
from ..streaming import live as L
from ..sources.tables import conversation_logs, events_log, orders_queue, table, user_logs

NOW = 1_706_745_600_000
TTL = 1_296_000_000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Views that the SQL of several queries starts with.
EV = """ev AS (SELECT 'events' AS topic, event_id + 1 AS seq, epoch_us(ts) // 1000 AS ts_ms, 'u' || user_id AS node, event_type AS tag,
  props AS data, CAST(strlen(props) AS BIGINT) AS bytes FROM events)"""
OR = """oq AS (SELECT 'orders' AS topic, o_orderkey + 1 AS seq, epoch_us(o_orderdate) // 1000 AS ts_ms, 'c' || o_custkey AS node,
  o_orderpriority AS tag, o_orderstatus AS data, CAST(strlen(o_orderstatus) AS BIGINT) AS bytes FROM orders)"""
CV = """cv AS (SELECT 'conv:' || conv_id AS topic, turn + 1 AS seq, conv_id * 1000 + turn AS ts_ms, CAST(NULL AS VARCHAR) AS node,
  role AS tag, text AS data, CAST(strlen(text) AS BIGINT) AS bytes FROM conversations)"""


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def cast(df: DataFrame, **kinds: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(k) for c, k in kinds.items()})


# --- append ------------------------------------------------------------------------------------------------------


@query(f"WITH {EV} SELECT node AS topic, row_number() OVER (PARTITION BY node ORDER BY seq) AS seq, seq AS pos FROM ev")
def append_assign_seq(spark, sf_dir):
    return user_logs(spark, sf_dir).select("topic", "seq", "pos")


@query(
    f"""WITH {EV}, old AS (SELECT node, count(*) AS head FROM ev WHERE seq % 10 < 3 GROUP BY node)
    SELECT e.node AS topic, coalesce(old.head, 0) + row_number() OVER (PARTITION BY e.node ORDER BY e.seq) AS seq, e.seq AS pos
    FROM ev e LEFT JOIN old ON e.node = old.node WHERE e.seq % 10 >= 3"""
)
def append_after_head(spark, sf_dir):
    log = events_log(spark, sf_dir).select(F.col("node").alias("topic"), F.col("seq").alias("pos"))
    heads = log.where("pos % 10 < 3").groupBy("topic").agg(F.count("*").alias("head"))
    return A.assign_seq(log.where("pos % 10 >= 3"), ["topic"], ["pos"], heads).select("topic", "seq", "pos")


@query(
    """WITH l AS (SELECT 's' || l_suppkey AS topic, l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY
      l_orderkey, l_linenumber, l_partkey, l_shipdate, l_quantity, l_extendedprice) AS seq FROM lineitem)
    SELECT topic, count(*) AS records, max(seq) AS head, CAST(sum(seq * (l_partkey % 97)) AS BIGINT) AS checksum FROM l GROUP BY topic"""
)
def bulk_append_seq(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("topic"), "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_quantity", "l_extendedprice")
    rows = A.assign_seq(rows, ["topic"], ["l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_quantity", "l_extendedprice"])
    return rows.groupBy("topic").agg(F.count("*").alias("records"), F.max("seq").alias("head"), F.sum(F.col("seq") * (F.col("l_partkey") % 97)).cast("long").alias("checksum"))


@query(f"WITH {EV} SELECT seq, CASE WHEN seq % 3 = 0 THEN 'writer' ELSE node END AS node, bytes FROM ev")
def append_batch_default_node(spark, sf_dir):
    batch = events_log(spark, sf_dir).withColumn("node", F.when(F.col("seq") % 3 != 0, F.col("node")))
    return A.prepared(batch, "writer").select("seq", "node", "bytes")


@query(f"WITH {EV} SELECT seq, CAST(strlen(data) + coalesce(strlen(CASE WHEN seq % 2 = 0 THEN '{{\"k\":1}}' END), 0) AS BIGINT) AS bytes FROM ev")
def record_bytes(spark, sf_dir):
    log = events_log(spark, sf_dir).withColumn("meta", F.when(F.col("seq") % 2 == 0, '{"k":1}'))
    return log.select("seq", X.record_bytes("data", "meta").alias("bytes"))


@query(
    f"""WITH {EV} SELECT count(CASE WHEN p = 'tag' THEN 1 END) AS tag, count(CASE WHEN p = 'node' THEN 1 END) AS node, count(CASE WHEN p IS NULL THEN 1 END) AS fine FROM (
      SELECT CASE WHEN strlen(repeat(tag, CASE WHEN seq % 100 = 0 THEN 60 ELSE 1 END)) > 256 THEN 'tag' WHEN strlen(repeat(node, CASE WHEN seq % 150 = 7 THEN 90 ELSE 1 END)) > 128 THEN 'node' END AS p FROM ev)"""
)
def append_limits(spark, sf_dir):
    log = events_log(spark, sf_dir)
    log = log.withColumn("tag", F.expr("repeat(tag, CASE WHEN seq % 100 = 0 THEN 60 ELSE 1 END)")).withColumn("node", F.expr("repeat(node, CASE WHEN seq % 150 = 7 THEN 90 ELSE 1 END)"))
    return A.prepared(log).agg(*[F.count(F.when(F.col("problem") == p, 1)).alias(p) for p in ("tag", "node")], F.count(F.when(F.col("problem").isNull(), 1)).alias("fine"))


@query(
    f"""WITH {EV}, a AS (SELECT count(*) AS count, CAST(sum(bytes) AS BIGINT) AS bytes FROM ev WHERE tag <> 'signup'),
    b AS (SELECT count(*) AS batch_count, CAST(sum(bytes) AS BIGINT) AS batch_bytes FROM ev WHERE tag = 'signup')
    SELECT count, bytes, batch_count, batch_bytes, CASE WHEN batch_count > 9000 OR batch_bytes > 88000 THEN 'record_too_large'
      WHEN count + batch_count > 9000 OR bytes + batch_bytes > 88000 THEN 'topic_full' ELSE 'admit' END AS outcome FROM a, b"""
)
def admit_reject(spark, sf_dir):
    log = events_log(spark, sf_dir)
    return A.admission(log.where("tag <> 'signup'"), log.where("tag = 'signup'"), 9000, 88_000)


@query(
    f"""WITH RECURSIVE {EV}, w AS (SELECT seq AS pos, CASE WHEN seq % 7 > 0 THEN node || ':' || tag END AS idem_key, ts_ms FROM ev),
    s AS (SELECT idem_key, min(pos) AS pos FROM w WHERE idem_key IS NOT NULL GROUP BY idem_key
      UNION ALL SELECT s.idem_key, (SELECT min(n.pos) FROM w n JOIN w o ON o.pos = s.pos WHERE n.idem_key = s.idem_key AND n.pos > s.pos AND n.ts_ms - o.ts_ms > 86400000)
      FROM s WHERE s.pos IS NOT NULL)
    SELECT w.pos, w.idem_key, w.ts_ms, w.idem_key IS NULL OR w.pos IN (SELECT pos FROM s WHERE pos IS NOT NULL) AS accepted,
      CASE WHEN w.idem_key IS NULL THEN w.pos ELSE max(CASE WHEN w.pos IN (SELECT pos FROM s WHERE pos IS NOT NULL) THEN w.pos END) OVER (PARTITION BY w.idem_key ORDER BY w.pos) END AS original_pos FROM w"""
)
def idempotent_write(spark, sf_dir):
    writes = events_log(spark, sf_dir).select(F.col("seq").alias("pos"), F.when(F.col("seq") % 7 > 0, F.concat_ws(":", "node", "tag")).alias("idem_key"), "ts_ms")
    return A.idempotent_writes(writes, 86_400_000)


# --- read --------------------------------------------------------------------------------------------------------

PAGE = "SELECT topic, seq, ts_ms, node, data, bytes FROM"


@query(f"WITH {EV} {PAGE} ev WHERE seq > 250 ORDER BY seq LIMIT 256")
def diff_basic(spark, sf_dir):
    return R.diff_page(events_log(spark, sf_dir, 250), 250)


@query(f"WITH {EV} {PAGE} ev WHERE seq > 10 AND {NOW} - ts_ms <= {TTL + 1_200_000_000} ORDER BY seq LIMIT 1000")
def diff_limit(spark, sf_dir):
    return R.diff_page(events_log(spark, sf_dir, 10), 10, 5000, now_ms=NOW, ttl_ms=TTL + 1_200_000_000)


@query(f"WITH {EV}, d AS (SELECT *, row_number() OVER (ORDER BY seq) AS rn, sum(bytes) OVER (ORDER BY seq) AS cum FROM ev WHERE seq > 100) {PAGE} d WHERE rn <= 1000 AND (rn = 1 OR cum <= 2000)")
def diff_byte_budget(spark, sf_dir):
    return R.diff_page(events_log(spark, sf_dir, 100), 100, 1000, 2000)


CURSOR = """p AS (SELECT *, rn <= {limit} AND (rn = 1 OR cum <= {budget}) AS inp FROM (
  SELECT *, row_number() OVER (ORDER BY seq) AS rn, sum(bytes) OVER (ORDER BY seq) AS cum FROM ev WHERE seq > {start} AND {more})),
f AS (SELECT count(CASE WHEN inp THEN 1 END) AS records, max(CASE WHEN inp THEN seq END) AS last, min(CASE WHEN NOT inp THEN seq END) AS cut FROM p),
h AS (SELECT max(seq) AS head FROM ev),
n AS (SELECT records, CASE WHEN records = {limit} THEN last WHEN cut IS NOT NULL THEN cut - 1 ELSE greatest(head, {start}) END AS next_from_seq, head FROM f, h)
SELECT records, next_from_seq, head, next_from_seq = head AS caught_up, head - next_from_seq AS lag FROM n"""


@query(f"WITH {EV}, " + CURSOR.format(limit=1000, budget=2000, start=100, more="node NOT IN ('u1', 'u2')"))
def diff_next_cursor(spark, sf_dir):
    head = events_log(spark, sf_dir).agg(F.coalesce(F.max("seq"), F.lit(0)).cast("long").alias("head"))
    return R.diff_cursor(events_log(spark, sf_dir, 100), 100, 1000, 2000, nodes=["u1", "u2"], head=head)


@query(f"WITH {EV}, " + CURSOR.format(limit=1000, budget=1 << 20, start=990, more="tag = 'nothing'"))
def diff_caught_up(spark, sf_dir):
    return R.diff_cursor(events_log(spark, sf_dir), 990, 1000, now_ms=NOW + 10 * TTL, ttl_ms=1)


@query(f"WITH {EV} {PAGE} ev WHERE seq > 0 AND (node IS NULL OR node <> 'u3') ORDER BY seq LIMIT 256")
def diff_node_filter(spark, sf_dir):
    return R.diff_page(events_log(spark, sf_dir), 0, nodes="u3")


@query(f"WITH {EV}, e2 AS (SELECT topic, seq, ts_ms, CASE WHEN seq % 5 > 0 THEN node END AS node, data, bytes FROM ev) {PAGE} e2 WHERE seq > 0 AND (node IS NULL OR node NOT IN ('u1', 'u2', 'u3', 'u4')) ORDER BY seq LIMIT 500")
def diff_node_filter_set(spark, sf_dir):
    log = events_log(spark, sf_dir).withColumn("node", F.when(F.col("seq") % 5 > 0, F.col("node")))
    return R.diff_page(log, 0, 500, nodes=["u1", "u2", "u3", "u4"])


@query(f"WITH {EV} SELECT topic, seq, ts_ms, node, tag, data, bytes FROM ev WHERE seq > 40 ORDER BY seq LIMIT 20")
def diff_projection(spark, sf_dir):
    return R.diff_page(events_log(spark, sf_dir, 40), 40, 20, tags=True)


@query(
    f"""WITH {EV} SELECT seq, CASE WHEN {NOW} - ts_ms > {TTL} THEN 'expired' WHEN seq < 700 THEN 'deleted'
    WHEN node IN ('u1', 'u5') THEN 'node_filtered' ELSE 'deliver' END AS decision FROM ev"""
)
def read_decisions(spark, sf_dir):
    return R.decisions(events_log(spark, sf_dir), NOW, TTL, ["u1", "u5"], 700).select("seq", "decision")


@query(f"WITH {EV}, {CV} SELECT topic, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM (SELECT * FROM cv UNION ALL SELECT * FROM ev) WHERE starts_with(topic, 'conv:1') OR starts_with(topic, 'ev') GROUP BY topic")
def allowlist_prefix(spark, sf_dir):
    logs = conversation_logs(spark, sf_dir).union(events_log(spark, sf_dir))
    return logs.where(X.allowed(["conv:1", "ev"], "topic")).groupBy("topic").agg(F.count("*").alias("n"), F.sum("bytes").cast("long").alias("bytes"))


@query(f"WITH {EV} SELECT tag, count(*) AS n FROM ev WHERE tag = 'click' GROUP BY tag UNION ALL SELECT 'prefix', count(*) FROM ev WHERE starts_with(tag, 'p') UNION ALL SELECT 'literal', count(*) FROM ev WHERE starts_with(tag, '%')")
def tag_match(spark, sf_dir):
    log = events_log(spark, sf_dir)
    n = lambda name, spec: log.where(X.TagFilter.parse(spec).column()).agg(F.lit(name).alias("tag"), F.count("*").alias("n"))
    return n("click", "click").union(n("prefix", ["tag", "Glob", "p*"])).union(n("literal", "%*"))


# --- retention ---------------------------------------------------------------------------------------------------


def _floors(spark, sf_dir, **k):
    return T.floors(events_log(spark, sf_dir), NOW, **k)


@query(f"WITH {EV} SELECT 'events' AS topic, coalesce(min(CASE WHEN {NOW} - ts_ms <= {TTL} THEN seq END), max(seq) + 1) - 1 AS expiry_floor FROM ev")
def ttl_floor(spark, sf_dir):
    return _floors(spark, sf_dir, ttl_ms=TTL).select("topic", "expiry_floor")


@query(f"WITH {EV} SELECT 'events' AS topic, greatest(max(seq) - 300, 0) AS evict_floor FROM ev")
def cap_records_floor(spark, sf_dir):
    return _floors(spark, sf_dir, cap_records=300).select("topic", "evict_floor")


BYTES = "coalesce((SELECT max(seq) FROM (SELECT seq, sum(bytes) OVER (ORDER BY seq DESC) AS c FROM ev) WHERE c > {0}), 0)"


@query(f"WITH {EV} SELECT 'events' AS topic, {BYTES.format(2000)} AS evict_floor")
def cap_bytes_floor(spark, sf_dir):
    return _floors(spark, sf_dir, cap_bytes=2000).select("topic", "evict_floor")


@query(f"WITH {EV} SELECT 'events' AS topic, greatest((SELECT max(seq) - 300 FROM ev), {BYTES.format(2000)}) AS evict_floor")
def cap_both_floor(spark, sf_dir):
    return _floors(spark, sf_dir, cap_bytes=2000, cap_records=300).select("topic", "evict_floor")


MARK = """c AS (SELECT 'events' AS topic, max(seq) AS head, min(seq) AS base, {cap} AS ef, {ttl} AS xf, {trim} AS sf, {gone} AS df FROM ev),
w AS (SELECT *, CAST(greatest(ef, xf, sf) + 1 AS BIGINT) AS evict_earliest, coalesce((SELECT min(seq) FROM ev WHERE seq > greatest(ef, xf, sf, df)), head + 1) AS earliest_seq FROM c),
m AS (SELECT *, {start} > head AS fresh, {start} + 1 < evict_earliest AS lost FROM w)
SELECT topic, head, earliest_seq, evict_earliest, fresh OR lost AS marked,
  CASE WHEN fresh THEN base WHEN lost THEN {start} + 1 END AS gap_from, CASE WHEN fresh THEN head WHEN lost THEN evict_earliest - 1 END AS gap_to,
  CASE WHEN fresh THEN 'recreated' WHEN lost THEN CASE WHEN ef >= {start} + 1 AND xf >= {start} + 1 THEN 'mixed' WHEN ef >= {start} + 1 THEN 'cap' WHEN xf >= {start} + 1 THEN 'ttl'
    WHEN sf >= {start} + 1 THEN 'source_trim' ELSE 'cap' END END AS reason,
  CASE WHEN fresh THEN head - base + 1 WHEN lost THEN evict_earliest - 1 - {start} END AS missed_estimate,
  CASE WHEN fresh THEN earliest_seq - 1 WHEN lost THEN greatest(earliest_seq - 1, {start}) ELSE {start} END AS resume_from FROM m"""
EXPIRY = f"coalesce(min(CASE WHEN {NOW} - ts_ms <= {TTL} THEN seq END), max(seq) + 1) - 1"


def mark(start, cap="0", ttl="0", trim="0", gone="0"):
    return f"WITH {EV}, " + MARK.format(start=start, cap=cap, ttl=ttl, trim=trim, gone=gone)


def _marks(spark, sf_dir, start, **k):
    log = events_log(spark, sf_dir)
    return T.tombstones(T.watermarks(T.floors(log, NOW, **k), log), start)


@query(f"WITH {EV} SELECT 'events' AS topic, count(*) AS count, CAST(sum(bytes) AS BIGINT) AS bytes, min(seq) AS earliest_seq, (SELECT max(seq) - 300 FROM ev) + 1 AS evict_earliest FROM ev WHERE seq > (SELECT greatest(max(seq) - 300, 799) FROM ev)")
def earliest_seq(spark, sf_dir):
    log = events_log(spark, sf_dir)
    return T.watermarks(T.floors(log, NOW, cap_records=300, before_seq=800), log).select("topic", "count", "bytes", "earliest_seq", "evict_earliest")


@query(mark(5, cap="max(seq) - 300"))
def tombstone_cap(spark, sf_dir):
    return _marks(spark, sf_dir, 5, cap_records=300)


@query(mark(5, ttl=EXPIRY))
def tombstone_ttl(spark, sf_dir):
    return _marks(spark, sf_dir, 5, ttl_ms=TTL)


@query(mark(5, cap="max(seq) - 300", ttl=EXPIRY))
def tombstone_mixed(spark, sf_dir):
    return _marks(spark, sf_dir, 5, cap_records=300, ttl_ms=TTL)


@query(mark(5, trim="500"))
def tombstone_source_trim(spark, sf_dir):
    return _marks(spark, sf_dir, 5, trimmed_to=500)


@query(mark(100_000_000))
def tombstone_recreated(spark, sf_dir):
    return _marks(spark, sf_dir, 100_000_000)


@query(mark(5, gone="600"))
def tombstone_silent_delete(spark, sf_dir):
    return _marks(spark, sf_dir, 5, before_seq=601)


@query(f"WITH {EV} SELECT 'events' AS topic, true AS marked, 'from_seq_too_old' AS reason, 6 AS gap_from, max(seq) - 300 AS gap_to FROM ev")
def connect_reason(spark, sf_dir):
    log = events_log(spark, sf_dir)
    out = T.tombstones(T.watermarks(T.floors(log, NOW, cap_records=300), log), 5, connecting=True)
    return cast(out.select("topic", "marked", "reason", "gap_from", "gap_to"), gap_from="int")


@query(f"WITH {EV} SELECT 'events' AS topic, greatest((SELECT max(seq) - 300 FROM ev), 850) AS evict_floor, 40 AS expiry_floor")
def hardened_floors(spark, sf_dir):
    history = spark.createDataFrame([("events", 850, 40, 0, 0), ("events", 100, 20, 0, 0)], "topic string, evict_floor long, expiry_floor long, delete_floor long, source_trim_floor long")
    return cast(T.hardened(_floors(spark, sf_dir, cap_records=300), history).select("topic", "evict_floor", "expiry_floor"), expiry_floor="int")


SEG = f"WITH {EV}, sg AS (SELECT topic, (seq - 1) // 100 AS segment, min(seq) AS first_seq, CAST(sum(bytes) AS BIGINT) AS bytes FROM ev GROUP BY topic, (seq - 1) // 100)"


def _segments(log):
    return log.groupBy("topic", F.expr("(seq - 1) DIV 100").alias("segment")).agg(F.min("seq").alias("first_seq"), F.sum("bytes").cast("long").alias("bytes"))


@query(
    SEG + """ SELECT topic, first_seq, bytes, CASE WHEN row_number() OVER (ORDER BY first_seq DESC) <= 2 OR sum(bytes) OVER (ORDER BY first_seq DESC) <= 4000 THEN 'hot' ELSE 'cold' END AS tier FROM sg"""
)
def tier_plan(spark, sf_dir):
    return T.tier_plan(_segments(events_log(spark, sf_dir)).withColumn("sealed", F.lit(True)), 2, 4000)


@query(SEG + " SELECT topic, segment, first_seq, bytes FROM sg WHERE segment * 100 + 100 < 651")
def dead_segments(spark, sf_dir):
    log = events_log(spark, sf_dir)
    return T.dead_segments(_segments(log), log.where("seq >= 651"), 100)


def runs_sql(limit, ends):
    """Runs of ``lg`` (topic, seq, bytes) by the rule itself: from each start the next is the first row at which the run has ended."""
    return f"""t AS (SELECT topic, seq, bytes, sum(bytes) OVER (PARTITION BY topic ORDER BY seq) - bytes AS b, row_number() OVER (PARTITION BY topic ORDER BY seq) AS n FROM lg),
    s AS (SELECT topic, 1 AS run, CAST(1 AS BIGINT) AS a FROM t WHERE n = 1
      UNION ALL SELECT s.topic, s.run + 1, (SELECT min(x.n) FROM t x JOIN t o ON o.topic = s.topic AND o.n = s.a WHERE x.topic = s.topic AND x.n > s.a AND (x.n - s.a >= {limit} OR {ends})) FROM s WHERE s.a IS NOT NULL),
    q AS (SELECT topic, run, a, lead(a) OVER (PARTITION BY topic ORDER BY run) AS z FROM s WHERE a IS NOT NULL),
    r AS (SELECT q.topic, q.run, min(t.seq) AS first_seq, max(t.seq) AS last_seq, count(*) AS records, CAST(sum(t.bytes) AS BIGINT) AS bytes
      FROM q JOIN t ON t.topic = q.topic AND t.n >= q.a AND (q.z IS NULL OR t.n < q.z) GROUP BY q.topic, q.run)"""


@query(f"WITH RECURSIVE {EV}, lg AS (SELECT topic, seq, bytes FROM ev), " + runs_sql(64, "x.b - o.b >= 700") + " SELECT topic, CAST(run AS INTEGER) AS segment, first_seq, last_seq, records, bytes FROM r")
def seal_segments(spark, sf_dir):
    return T.seal_segments(events_log(spark, sf_dir), 64, 700)


# --- delete ------------------------------------------------------------------------------------------------------


def _deleted(spark, sf_dir, *rows, log=None):
    log = events_log(spark, sf_dir) if log is None else log
    return D.live_records(log, spark.createDataFrame(list(rows), D.CONTROL))


def _head(log):
    """The last sequence of a log, 0 of an empty one: what a delete of now is pinned to."""
    return log.agg(F.max("seq")).first()[0] or 0


@query(f"WITH {EV} SELECT seq, tag FROM ev WHERE seq >= 400")
def delete_before_seq(spark, sf_dir):
    return _deleted(spark, sf_dir, D.delete_row(1, "events", 1_000_000, before_seq=400)).select("seq", "tag")


@query(f"WITH {EV} SELECT seq, tag FROM ev WHERE tag <> 'click'")
def delete_tag_eq(spark, sf_dir):
    log = events_log(spark, sf_dir)
    return _deleted(spark, sf_dir, D.delete_row(1, "events", _head(log), match="click"), log=log).select("seq", "tag")


@query(f"WITH {EV} SELECT seq, tag FROM ev WHERE NOT starts_with(tag, 'e') AND NOT starts_with(tag, 'pur')")
def delete_tag_glob(spark, sf_dir):
    log = events_log(spark, sf_dir)
    head = _head(log)
    return _deleted(spark, sf_dir, D.delete_row(1, "events", head, match=["tag", "Glob", "e*"]), D.delete_row(2, "events", head, match="pur*"), log=log).select("seq", "tag")


@query(f"WITH {EV} SELECT seq, tag FROM ev WHERE NOT (tag = 'view' AND seq < 500)")
def delete_and(spark, sf_dir):
    return _deleted(spark, sf_dir, D.delete_row(1, "events", 1_000_000, before_seq=500, match="view")).select("seq", "tag")


@query(f"WITH {EV}, e2 AS (SELECT seq, CASE WHEN seq % 4 > 0 THEN tag END AS tag FROM ev) SELECT seq, tag FROM e2 WHERE NOT coalesce(tag = 'error' AND seq <= 600, false)")
def delete_point_in_time(spark, sf_dir):
    log = events_log(spark, sf_dir).withColumn("tag", F.when(F.col("seq") % 4 > 0, F.col("tag")))
    return _deleted(spark, sf_dir, D.delete_row(1, "events", 600, match="error"), log=log).select("seq", "tag")


@query(f"WITH {EV} SELECT seq, tag FROM ev WHERE seq NOT IN (3, 5, 8, 999)")
def delete_seq_set(spark, sf_dir):
    return _deleted(spark, sf_dir, D.delete_row(1, "events", 1_000_000, seqs=[3, 5, 8]), D.delete_row(2, "events", 1_000_000, seqs=[999, 3])).select("seq", "tag")


@query(f"WITH {EV}, a AS (SELECT * FROM ev WHERE NOT (seq < 200 OR tag = 'view')) SELECT 'events' AS topic, (SELECT count(*) FROM ev) - count(*) AS deleted, min(seq) AS earliest_seq, (SELECT max(seq) FROM ev) AS head, count(*) AS count, CAST(sum(bytes) AS BIGINT) AS bytes FROM a")
def delete_stats(spark, sf_dir):
    log = events_log(spark, sf_dir)
    head = _head(log)
    after = _deleted(spark, sf_dir, D.delete_row(1, "events", head, before_seq=200), D.delete_row(2, "events", head, match="view"), log=log)
    return D.delete_stats(log, after)


# --- catalog -----------------------------------------------------------------------------------------------------


@query(f"WITH {CV} SELECT topic, count(*) AS count, CAST(sum(bytes) AS BIGINT) AS bytes, min(seq) AS earliest_seq, max(seq) AS head, min(ts_ms) AS first_ts_ms, max(ts_ms) AS last_ts_ms FROM cv GROUP BY topic")
def topic_state(spark, sf_dir):
    return K.topic_state(conversation_logs(spark, sf_dir))


NAMES = f"WITH {CV}, nm AS (SELECT DISTINCT topic AS name FROM cv)"


def _names(spark, sf_dir):
    return conversation_logs(spark, sf_dir).select(F.col("topic").alias("name")).distinct()


@query(NAMES + " SELECT name, (SELECT count(*) FROM nm WHERE name > 'conv:15') > 20 AS more, base64(CAST('{\"after\":\"' || name || '\"}' AS BLOB)) AS cursor FROM nm WHERE name > 'conv:15' ORDER BY name LIMIT 20")
def list_page(spark, sf_dir):
    return K.list_page(_names(spark, sf_dir), "conv:15", limit=20)


@query(NAMES + " SELECT name, (SELECT count(*) FROM nm WHERE starts_with(name, 'conv:2')) > 1000 AS more, base64(CAST('{\"after\":\"' || name || '\"}' AS BLOB)) AS cursor FROM nm WHERE starts_with(name, 'conv:2') ORDER BY name LIMIT 1000")
def list_prefix(spark, sf_dir):
    return K.list_page(_names(spark, sf_dir), prefix="conv:2", limit=9999)


#: A router for each supplier, from its nation's log.
ROUTERS = "rt AS (SELECT 'r' || s_suppkey AS name, 't' || s_nationkey AS source, 't' || (s_suppkey * 3 + 1) % 40 AS dest FROM supplier)"


def _routers(spark, sf_dir):
    s = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("r"), s).alias("name"), F.concat(F.lit("t"), F.col("s_nationkey")).alias("source"), F.concat(F.lit("t"), (s * 3 + 1) % 40).alias("dest"))


@query(f"WITH {ROUTERS}, d AS (SELECT 't' || n_nationkey AS topic FROM nation WHERE n_regionkey = 1) SELECT DISTINCT rt.* FROM rt JOIN d ON d.topic IN (rt.source, rt.dest)")
def delete_cascade(spark, sf_dir):
    dropped = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.concat(F.lit("t"), F.col("n_nationkey")).alias("topic"))
    return K.delete_cascade(_routers(spark, sf_dir), dropped)


@query(f"WITH {ROUTERS} SELECT name, source, dest FROM rt WHERE source = 't2' AND starts_with(name, 'r1') ORDER BY name LIMIT 100")
def list_routers(spark, sf_dir):
    return K.list_routers(_routers(spark, sf_dir), source="t2", prefix="r1")


@query(f"WITH {EV} SELECT tag AS topic, count(*) AS count, CAST(sum(bytes) AS BIGINT) AS bytes, min(seq) AS earliest_seq, max(seq) AS head, min(ts_ms) AS first_ts_ms, max(ts_ms) AS last_ts_ms FROM ev GROUP BY tag")
def metrics_by_topic(spark, sf_dir):
    return K.topic_state(events_log(spark, sf_dir).withColumn("topic", F.col("tag")))


@query(
    f"""WITH {EV}, p AS (SELECT node AS topic, count(*) AS n, sum(bytes) AS b FROM ev GROUP BY node)
    SELECT CASE WHEN CAST(substr(topic, 2) AS BIGINT) % 3 = 0 THEN 'memory' ELSE 'disk' END AS class, count(*) AS logs, CAST(sum(n) AS BIGINT) AS records, CAST(sum(b) AS BIGINT) AS bytes FROM p GROUP BY 1"""
)
def metrics_by_class(spark, sf_dir):
    log = events_log(spark, sf_dir).withColumn("topic", F.col("node"))
    configs = log.select("topic").distinct().withColumn("class", F.when(F.substring("topic", 2, 20).cast("long") % 3 == 0, "memory").otherwise("disk"))
    return K.metrics_by_class(log, configs)


@query(
    "WITH o AS (SELECT CAST(round(value * 100) AS BIGINT) AS us FROM events), b(le_us) AS (VALUES (50), (100), (250), (500), (1000), (5000), (10000), (50000), (100000)) "
    "SELECT CAST(le_us AS BIGINT) AS le_us, (SELECT count(*) FROM o WHERE us <= le_us) AS observations, (SELECT CAST(sum(us) AS BIGINT) FROM o) AS sum_us FROM b "
    "UNION ALL SELECT NULL, (SELECT count(us) FROM o), (SELECT CAST(sum(us) AS BIGINT) FROM o)"
)
def latency_histogram(spark, sf_dir):
    return K.latency_histogram(table(spark, sf_dir, "events").select(F.round(F.col("value") * 100).cast("long").alias("us")), "us")


@query(
    """WITH c AS (SELECT event_id AS pos, 'u' || user_id AS name, event_type AS config, event_type = 'error' AS deleted FROM events)
    SELECT name, pos, config, deleted FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY pos DESC) AS n FROM c) WHERE n = 1 AND NOT deleted"""
)
def catalog_latest(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.concat(F.lit("u"), F.col("user_id")).alias("name"), F.col("event_type").alias("config"), (F.col("event_type") == "error").alias("deleted"))
    return K.latest(rows)


@query(f"WITH {EV} SELECT CAST(sum(bytes) AS BIGINT) AS bytes, sum(bytes) <= 50000 AS within FROM ev")
def global_quota(spark, sf_dir):
    return K.quota(events_log(spark, sf_dir), 50_000)


# --- routers -----------------------------------------------------------------------------------------------------

FWD = "'dest' AS topic, 70 + row_number() OVER (ORDER BY seq) AS seq, {now} AS ts_ms, {node} AS node, {tag} AS tag, data, bytes, 1 AS hops, seq AS source_seq"


def fwd(where, node="node", tag="tag"):
    return f"WITH {EV} SELECT " + FWD.format(now=NOW, node=node, tag=tag) + f" FROM ev WHERE {where}"


@query(fwd("seq > 100 AND seq <= 1000"))
def router_forward(spark, sf_dir):
    log = events_log(spark, sf_dir, 100)
    return O.forward(O.forward_window(log, 100, 1000), "dest", 70, NOW).drop("source_key")


@query(fwd("seq <= 1024 AND tag = 'purchase'"))
def router_filter(spark, sf_dir):
    return O.forward(O.forward_window(events_log(spark, sf_dir), 0, 1 << 40), "dest", 70, NOW, match="purchase").drop("source_key")


@query(fwd("seq <= 1024 AND starts_with(tag, 's')", "CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)"))
def router_clear_node_tag(spark, sf_dir):
    return O.forward(O.forward_window(events_log(spark, sf_dir), 0, 1 << 40), "dest", 70, NOW, match="s*", preserve_node=False, preserve_tag=False).drop("source_key")


@query(f"WITH {EV} SELECT topic, max(seq) AS head, count(*) AS n FROM (SELECT tag AS topic, row_number() OVER (PARTITION BY tag ORDER BY seq) AS seq FROM ev) GROUP BY topic")
def router_dest_seq(spark, sf_dir):
    log = events_log(spark, sf_dir).withColumn("topic", F.col("tag")).withColumnRenamed("seq", "source_seq")
    return A.assign_seq(log, ["topic"], ["source_seq"]).groupBy("topic").agg(F.max("seq").alias("head"), F.count("*").alias("n"))


@query(fwd("seq <= 1000 AND seq % 3 > 0"))
def router_exactly_once(spark, sf_dir):
    log = O.forward_window(events_log(spark, sf_dir), 0, 1000)
    there = log.where("seq % 3 = 0").select(F.concat_ws(":", F.lit("mirror"), "topic", F.col("seq").cast("string")).alias("source_key"))
    return O.forward(log, "dest", 70, NOW, dest_keys=there, router="mirror").drop("source_key")


@query(f"WITH {EV} SELECT 'dest' AS topic, 70 + row_number() OVER (ORDER BY seq) AS seq, seq AS source_seq, CAST(seq % 12 + 1 AS INTEGER) AS hops FROM ev WHERE seq <= 1024 AND seq % 12 < 8")
def router_hop_cap(spark, sf_dir):
    log = O.forward_window(events_log(spark, sf_dir), 0, 1 << 40).withColumn("hops", (F.col("seq") % 12).cast("int"))
    return O.forward(log, "dest", 70, NOW).select("topic", "seq", "source_seq", "hops")


@query(f"WITH {EV}, f AS (SELECT seq, row_number() OVER (ORDER BY seq) AS n, sum(bytes) OVER (ORDER BY seq) AS b FROM ev WHERE seq <= 1024 AND tag <> 'view') SELECT seq AS source_seq, 70 + n AS seq FROM f WHERE n <= 200 AND b <= 1500")
def router_backpressure(spark, sf_dir):
    log = O.forward_window(events_log(spark, sf_dir), 0, 1 << 40).where("tag <> 'view'")
    return O.forward(log, "dest", 70, NOW, room_records=200, room_bytes=1500).select("source_seq", "seq")


# The six queries above show one pass of at most a batch; these take the log from the cursor to its head.


@query(fwd("seq > 100"))
def router_forward_log(spark, sf_dir):
    return O.forward(O.pending(events_log(spark, sf_dir, 100), 100), "dest", 70, NOW).drop("source_key")


@query(fwd("tag = 'purchase'"))
def router_filter_log(spark, sf_dir):
    return O.forward(O.pending(events_log(spark, sf_dir), 0), "dest", 70, NOW, match="purchase").drop("source_key")


@query(fwd("starts_with(tag, 's')", "CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)"))
def router_clear_node_tag_log(spark, sf_dir):
    return O.forward(O.pending(events_log(spark, sf_dir), 0), "dest", 70, NOW, match="s*", preserve_node=False, preserve_tag=False).drop("source_key")


@query(fwd("seq % 3 > 0"))
def router_exactly_once_log(spark, sf_dir):
    log = O.pending(events_log(spark, sf_dir), 0)
    there = log.where("seq % 3 = 0").select(F.concat_ws(":", F.lit("mirror"), "topic", F.col("seq").cast("string")).alias("source_key"))
    return O.forward(log, "dest", 70, NOW, dest_keys=there, router="mirror").drop("source_key")


@query(f"WITH {EV} SELECT 'dest' AS topic, 70 + row_number() OVER (ORDER BY seq) AS seq, seq AS source_seq, CAST(seq % 12 + 1 AS INTEGER) AS hops FROM ev WHERE seq % 12 < 8")
def router_hop_cap_log(spark, sf_dir):
    log = O.pending(events_log(spark, sf_dir), 0).withColumn("hops", (F.col("seq") % 12).cast("int"))
    return O.forward(log, "dest", 70, NOW).select("topic", "seq", "source_seq", "hops")


@query(
    f"""WITH {EV}, h AS (SELECT max(seq) AS head FROM ev), f AS (SELECT seq, row_number() OVER (ORDER BY seq) AS n, sum(bytes) OVER (ORDER BY seq) AS b FROM ev WHERE tag <> 'view')
    SELECT seq AS source_seq, 70 + n AS seq FROM f, h WHERE n <= head // 2 AND b <= head * 5"""
)
def router_backpressure_log(spark, sf_dir):
    """A destination with room for half as many records as the source has, and five bytes for each."""
    log = events_log(spark, sf_dir)
    head = log.agg(F.max("seq")).first()[0] or 0
    return O.forward(O.pending(log, 0).where("tag <> 'view'"), "dest", 70, NOW, room_records=head // 2, room_bytes=head * 5).select("source_seq", "seq")


@query(
    f"""WITH {EV}, u AS (SELECT node AS topic, count(*) AS head FROM ev GROUP BY node), c AS (SELECT topic, head // 4 AS cursor, greatest(head - 20, 0) + 1 AS earliest FROM u)
    SELECT topic, cursor + 1 AS first, earliest - 1 AS last, earliest - 1 - cursor AS holes FROM c WHERE earliest - 1 > cursor"""
)
def router_source_trim(spark, sf_dir):
    """Every user's log keeps twenty records; its router has forwarded a quarter."""
    logs = user_logs(spark, sf_dir)
    state = T.watermarks(T.floors(logs, NOW, cap_records=20), logs)
    return O.source_trim(state.select("topic", F.expr("head DIV 4").alias("cursor")), state)


EDGES = "ed AS (SELECT DISTINCT 'u' || user_id % 12 AS source, 'u' || (user_id * 5 + 3) % 12 AS dest FROM events)"


def _edges(spark, sf_dir):
    u = F.col("user_id")
    return table(spark, sf_dir, "events").select(F.concat(F.lit("u"), u % 12).alias("source"), F.concat(F.lit("u"), (u * 5 + 3) % 12).alias("dest")).distinct()


#: Up to three edges out of every user, to users of the same thirty.
BRANCHES = """ed AS (SELECT DISTINCT 'u' || user_id AS source, 'u' || ((user_id // 30) * 30 + (user_id * 5 + event_id % 3 * 11 + 3) % 30) AS dest FROM events)"""


@query(f"WITH RECURSIVE {BRANCHES}, w AS (SELECT source, dest FROM ed UNION SELECT w.source, e.dest FROM w JOIN ed e ON w.dest = e.source) SELECT source, dest, source = dest AS cycle FROM w")
def router_cycle(spark, sf_dir):
    dest = F.expr("user_id DIV 30 * 30 + (user_id * 5 + event_id % 3 * 11 + 3) % 30")
    edges = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id")).alias("source"), F.concat(F.lit("u"), dest).alias("dest"))
    return O.reachable(edges).withColumn("cycle", F.col("source") == F.col("dest"))


@query(
    f"""WITH RECURSIVE {EDGES}, h AS (SELECT 'u' || user_id % 12 AS topic, 0 AS hops, count(*) AS records FROM events GROUP BY 1
      UNION ALL SELECT e.dest, h.hops + 1, h.records FROM h JOIN ed e ON h.topic = e.source WHERE h.hops < 8)
    SELECT topic, CAST(hops AS INTEGER) AS hops, CAST(sum(records) AS BIGINT) AS records FROM h GROUP BY topic, hops"""
)
def router_fixpoint(spark, sf_dir):
    u = F.col("user_id")
    seeds = table(spark, sf_dir, "events").groupBy(F.concat(F.lit("u"), u % 12).alias("topic")).agg(F.count("*").alias("records"))
    return O.hop_closure(seeds, _edges(spark, sf_dir))


# --- queues ------------------------------------------------------------------------------------------------------

#: A claim of every order, and what became of it, all from arithmetic on seq.
LEASES = """lv AS (
  SELECT seq AS pos, seq, 'claimed' AS event, 'w' || seq % 4 AS node, seq AS lease_id, 1000 + seq % 9 * 100 AS deadline_ms, CAST(NULL AS BIGINT) AS ready_at_ms, 0 AS ts_ms FROM oq
  UNION ALL SELECT 1000000000 + seq, seq, 'released', 'w' || seq % 4, seq, NULL, CASE WHEN seq % 10 = 0 THEN 5000 END, 100 FROM oq WHERE seq % 5 = 0
  UNION ALL SELECT 2000000000 + seq, seq, 'claimed', 'x', 1000000000 + seq, 1800, NULL, 200 FROM oq WHERE seq % 15 = 0
  UNION ALL SELECT 3000000000 + seq, seq, 'extended', 'w' || seq % 4, seq, 2500, NULL, 300 FROM oq WHERE seq % 7 = 0
  UNION ALL SELECT 4000000000 + seq, seq, 'acked', 'w' || seq % 4, seq, NULL, NULL, 400 FROM oq WHERE seq % 11 = 0)"""
FOLD = """cl AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY pos DESC) AS n FROM lv WHERE event = 'claimed'),
fo AS (SELECT c.seq, c.lease_id, c.node, coalesce((SELECT e.deadline_ms FROM lv e WHERE e.event = 'extended' AND e.seq = c.seq AND e.lease_id = c.lease_id ORDER BY e.pos DESC LIMIT 1), c.deadline_ms) AS deadline_ms,
    EXISTS (SELECT 1 FROM lv e WHERE e.event = 'released' AND e.seq = c.seq AND e.lease_id = c.lease_id) AS released,
    EXISTS (SELECT 1 FROM lv e WHERE e.event = 'acked' AND e.seq = c.seq AND e.lease_id = c.lease_id) AS acked,
    (SELECT count(*) FROM lv e WHERE e.event = 'claimed' AND e.seq = c.seq AND e.pos > coalesce((SELECT max(a.pos) FROM lv a WHERE a.event = 'acked' AND a.seq = c.seq), -1)) AS deliveries,
    (SELECT max(e.ready_at_ms) FROM lv e WHERE e.event = 'released' AND e.seq = c.seq AND e.lease_id = c.lease_id) AS ready_at_ms FROM cl c WHERE n = 1),
ls AS (SELECT seq, lease_id, node, deadline_ms, NOT released AND NOT acked AND 1500 <= deadline_ms AS leased, acked, deliveries, ready_at_ms FROM fo)"""
AVAIL = """av AS (SELECT q.seq, q.tag, q.node, q.data, q.bytes, coalesce(l.deliveries, 0) AS deliveries FROM oq q LEFT JOIN ls l ON q.seq = l.seq
  WHERE NOT coalesce(l.leased, false) AND NOT coalesce(l.acked, false) AND (l.ready_at_ms IS NULL OR l.ready_at_ms <= 1500))"""
AT = 1500


def _lease_events(queue: DataFrame) -> DataFrame:
    s, none = F.col("seq"), F.lit(None).cast("long")
    q = queue.select("seq")
    worker = F.concat(F.lit("w"), s % 4)
    part = lambda rows, base, event, node, lease, deadline, ready, ts: rows.select((F.lit(base * 1_000_000_000) + s).alias("pos"), "seq", F.lit(event).alias("event"), node.alias("node"), lease.alias("lease_id"), deadline.cast("long").alias("deadline_ms"), ready.cast("long").alias("ready_at_ms"), F.lit(ts).alias("ts_ms"))
    return (
        part(q, 0, "claimed", worker, s, 1000 + s % 9 * 100, none, 0)
        .union(part(q.where("seq % 5 = 0"), 1, "released", worker, s, none, F.when(s % 10 == 0, 5000), 100))
        .union(part(q.where("seq % 15 = 0"), 2, "claimed", F.lit("x"), 1_000_000_000 + s, F.lit(1800), none, 200))
        .union(part(q.where("seq % 7 = 0"), 3, "extended", worker, s, F.lit(2500), none, 300))
        .union(part(q.where("seq % 11 = 0"), 4, "acked", worker, s, none, none, 400))
    )


def _queue(spark, sf_dir):
    queue = orders_queue(spark, sf_dir)
    leases = Q.lease_fold(_lease_events(queue), AT)
    return queue, leases, Q.claimable(queue, leases, AT)


@query(f"WITH {OR}, {LEASES}, {FOLD} SELECT * FROM ls")
def lease_fold(spark, sf_dir):
    return _queue(spark, sf_dir)[1]


@query(f"WITH {OR}, {LEASES}, {FOLD}, {AVAIL} SELECT seq, 'w1' AS node, 5000 + row_number() OVER (ORDER BY seq) AS lease_id, {AT} + 30000 AS deadline_ms FROM av ORDER BY seq LIMIT 50")
def claim_greedy(spark, sf_dir):
    return cast(Q.claim(_queue(spark, sf_dir)[2], "w1", 50, 30_000, 5001, AT), deadline_ms="int")


@query(
    f"""WITH {OR}, {LEASES}, {FOLD}, {AVAIL}, cm(ord, node, m, lease_ms) AS (VALUES (0, 'a', 5, 30000), (1, 'b', 2, 50), (2, 'c', 40, 60000)),
    sl AS (SELECT ord, node, lease_ms, unnest(range(1, m + 1)) AS k FROM cm), s2 AS (SELECT *, row_number() OVER (ORDER BY k, ord) AS slot FROM sl),
    j AS (SELECT seq, row_number() OVER (ORDER BY seq) AS slot FROM av)
    SELECT j.seq, s2.node, 100 + s2.slot AS lease_id, CAST({AT} + greatest(100, least(86400000, s2.lease_ms)) AS BIGINT) AS deadline_ms FROM j JOIN s2 ON j.slot = s2.slot"""
)
def claim_cohort(spark, sf_dir):
    claimers = spark.createDataFrame([(0, "a", 5, 30_000), (1, "b", 2, 50), (2, "c", 40, 60_000)], "ord int, node string, max int, lease_ms long")
    return Q.cohort(_queue(spark, sf_dir)[2], claimers, 101, AT)


@query(f"WITH {OR}, {LEASES}, {FOLD}, {AVAIL} SELECT seq, deliveries FROM av ORDER BY seq LIMIT 100")
def claim_reclaim_first(spark, sf_dir):
    return _queue(spark, sf_dir)[2].select("seq", "deliveries").orderBy("seq").limit(100)


@query(
    f"""WITH {OR}, {LEASES}, {FOLD}, {AVAIL}, dl AS (SELECT *, '{{"$dead_letter_deliveries":"1","$dead_letter_from":"orders","$dead_letter_src_seq":"' || seq || '"' AS says FROM av WHERE deliveries + 1 > 1),
    dm AS (SELECT *, says || CASE WHEN seq % 4 = 0 THEN ',"a":[1,2.5],"z":{{"k":"v"}}}}' ELSE '}}' END AS meta FROM dl)
    SELECT 'dead' AS topic, 7 + row_number() OVER (ORDER BY seq) AS seq, {AT} AS ts_ms, node, tag, data, meta, CAST(strlen(data) + strlen(meta) AS BIGINT) AS bytes, seq AS source_seq FROM dm"""
)
def dead_letter(spark, sf_dir):
    """Some records have meta of their own, one with an old provenance."""
    own = F.when(F.col("seq") % 8 == 0, '{"z":{"k":"v"},"a":[1,2.5]}').when(F.col("seq") % 4 == 0, '{"z":{"k":"v"},"$dead_letter_from":"x","a":[1,2.5]}').when(F.col("seq") % 4 == 1, "[1]")
    dead = Q.dead_letters(_queue(spark, sf_dir)[2], 1).withColumn("meta", own)
    return Q.divert(dead, "orders", "dead", 7, AT, 1)


ASK = "ak AS (SELECT seq, CASE WHEN seq % 2 = 0 THEN 'w' || seq % 4 ELSE 'stranger' END AS node, CASE WHEN seq % 3 = 0 THEN seq + CASE WHEN seq % 6 = 0 THEN 1 ELSE 0 END END AS lease_id FROM oq)"
DONE = "dn AS (SELECT a.seq, a.node, l.lease_id AS held FROM ak a JOIN ls l ON a.seq = l.seq AND l.leased AND l.node = a.node AND (a.lease_id IS NULL OR a.lease_id = l.lease_id))"


def _asked(queue):
    s = F.col("seq")
    return queue.select("seq", F.when(s % 2 == 0, F.concat(F.lit("w"), s % 4)).otherwise("stranger").alias("node"), F.when(s % 3 == 0, s + F.when(s % 6 == 0, 1).otherwise(0)).alias("lease_id"))


@query(f"WITH {OR}, {LEASES}, {FOLD}, {ASK}, {DONE} SELECT a.seq, a.node, a.lease_id, d.seq IS NOT NULL AS done, (SELECT l.lease_id FROM ls l WHERE l.seq = a.seq AND l.leased) AS held_id FROM ak a LEFT JOIN dn d ON a.seq = d.seq")
def ack_fenced(spark, sf_dir):
    queue, leases, _ = _queue(spark, sf_dir)
    return Q.fenced(leases, _asked(queue))


def event_sql(event, deadline="NULL", ready="NULL"):
    return f"WITH {OR}, {LEASES}, {FOLD}, {ASK}, {DONE} SELECT seq, '{event}' AS event, node, held AS lease_id, CAST({deadline} AS BIGINT) AS deadline_ms, CAST({ready} AS BIGINT) AS ready_at_ms, CAST({AT} AS BIGINT) AS ts_ms FROM dn"


@query(event_sql("acked"))
def ack_events(spark, sf_dir):
    queue, leases, _ = _queue(spark, sf_dir)
    return Q.ack(leases, _asked(queue), AT)


@query(event_sql("released", ready=str(AT + 700)))
def nack_delayed(spark, sf_dir):
    queue, leases, _ = _queue(spark, sf_dir)
    return Q.nack(leases, _asked(queue), 700, AT)


@query(event_sql("extended", deadline=str(AT + 100)))
def extend(spark, sf_dir):
    queue, leases, _ = _queue(spark, sf_dir)
    return Q.extend(leases, _asked(queue), 20, AT)


@query(
    f"""WITH {OR}, {LEASES}, {FOLD}, r AS (SELECT coalesce(l.leased, false) AS f, NOT coalesce(l.leased, false) AND coalesce(l.ready_at_ms > {AT}, false) AS d FROM oq q LEFT JOIN ls l ON q.seq = l.seq WHERE NOT coalesce(l.acked, false))
    SELECT count(*) AS live, count(CASE WHEN NOT f AND NOT d THEN 1 END) AS ready, count(CASE WHEN f THEN 1 END) AS in_flight, count(CASE WHEN d THEN 1 END) AS delayed, CAST(0 AS BIGINT) AS dead_lettered FROM r"""
)
def queue_counters(spark, sf_dir):
    queue, leases, _ = _queue(spark, sf_dir)
    return Q.counters(queue, leases, AT)


@query(f"WITH {OR} SELECT seq, 'lease_' || lower(to_hex(seq * 7919)) AS name, seq * 7919 AS back FROM oq")
def lease_ids(spark, sf_dir):
    name = X.lease_name(F.col("seq") * 7919)
    return orders_queue(spark, sf_dir).select("seq", name.alias("name"), X.lease_number(name).alias("back"))


# --- watch -------------------------------------------------------------------------------------------------------


def _wanted(spark, sf_dir, tail: bool):
    i = F.substring("topic", 6, 20).cast("long")
    return conversation_logs(spark, sf_dir).select("topic").distinct().where(i % 2 == 0).select("topic", (i % 3).alias("from_seq"), (F.lit(tail) & (i % 4 == 0)).alias("tail"))


WANT = f"WITH {CV}, i AS (SELECT DISTINCT topic, CAST(substr(topic, 6) AS BIGINT) AS n FROM cv), h AS (SELECT topic, max(seq) AS head FROM cv GROUP BY topic)"


@query(WANT + " SELECT topic, seq, tag, bytes FROM (SELECT cv.*, row_number() OVER (PARTITION BY cv.topic ORDER BY seq) AS rn FROM cv JOIN i ON cv.topic = i.topic WHERE n % 2 = 0 AND seq > n % 3) WHERE rn <= 3")
def watch_multi_topic(spark, sf_dir):
    logs = conversation_logs(spark, sf_dir)
    return R.watch_batch(logs, R.watch_cursors(logs, _wanted(spark, sf_dir, False)), 3).select("topic", "seq", "tag", "bytes")


@query(WANT + " SELECT i.topic, CASE WHEN n % 4 = 0 THEN head ELSE n % 3 END AS from_seq FROM i JOIN h ON i.topic = h.topic WHERE n % 2 = 0")
def watch_tail(spark, sf_dir):
    return R.watch_cursors(conversation_logs(spark, sf_dir), _wanted(spark, sf_dir, True))


@query(WANT + " SELECT i.topic, CASE WHEN n % 5 = 0 THEN least(n % 3, 1) ELSE n % 3 END AS from_seq FROM i WHERE n % 2 = 0")
def watch_rewind(spark, sf_dir):
    session = _wanted(spark, sf_dir, False).select("topic", "from_seq")
    client = session.where(F.substring("topic", 6, 20).cast("long") % 5 == 0).select("topic", F.lit(1).cast("long").alias("from_seq"))
    return R.rewind(session, client)


@query(
    WANT + """, c AS (SELECT i.topic, n, CASE WHEN n % 10 = 0 THEN head WHEN n % 10 = 4 THEN head + 9 ELSE n % 3 END AS from_seq, head FROM i JOIN h ON i.topic = h.topic WHERE n % 2 = 0)
    SELECT c.topic, 1 AS ord, 'record' AS kind, seq FROM c JOIN cv ON c.topic = cv.topic WHERE seq > c.from_seq AND NOT (c.from_seq + 1 < 2 AND seq <= 1)
    UNION ALL SELECT topic, 2, 'caught_up', head FROM c UNION ALL SELECT topic, 0, 'tombstone', 1 FROM c WHERE from_seq + 1 < 2
    UNION ALL SELECT 'gone:' || topic, 0, 'topic_deleted', 0 FROM i WHERE n % 50 = 0"""
)
def caught_up_frames(spark, sf_dir):
    """Some cursors are at the head, some past it, and some names have no log."""
    logs = conversation_logs(spark, sf_dir)
    n = F.expr("try_cast(substring(topic, 6) AS BIGINT)")
    heads = logs.groupBy("topic").agg(F.max("seq").alias("head"))
    cursors = heads.where(n % 2 == 0).select("topic", F.when(n % 10 == 0, F.col("head")).when(n % 10 == 4, F.col("head") + 9).otherwise(n % 3).alias("from_seq"))
    gone = heads.where(n % 50 == 0).select(F.concat(F.lit("gone:"), "topic").alias("topic"), F.lit(0).cast("long").alias("from_seq"))
    return R.watch_frames(logs, cursors.union(gone), evicted=cursors.select("topic", F.lit(2).cast("long").alias("evict_earliest")))


@query(
    WANT.replace("WITH", "WITH RECURSIVE", 1) + """, w AS (SELECT topic, n % 3 AS from_seq FROM i WHERE n < 200), lg AS (SELECT cv.topic, seq, bytes FROM cv JOIN w ON cv.topic = w.topic WHERE seq > from_seq AND tag <> 'system'), """
    + runs_sql(4, "x.b + x.bytes - o.b > 900")
    + """, f AS (SELECT r.*, lag(last_seq) OVER (PARTITION BY r.topic ORDER BY run) AS p, lead(run) OVER (PARTITION BY r.topic ORDER BY run) AS nx FROM r)
    SELECT f.topic, CAST(run AS INTEGER) AS frame, coalesce(p, w.from_seq) AS from_seq, CASE WHEN nx IS NULL THEN head ELSE last_seq END AS to_seq, head, records, bytes FROM f JOIN w ON f.topic = w.topic JOIN h ON f.topic = h.topic"""
)
def watch_drain(spark, sf_dir):
    """Record frames of at most four records and 900 bytes, of the watched logs, without what the role of system wrote."""
    logs = conversation_logs(spark, sf_dir)
    n = F.substring("topic", 6, 20).cast("long")
    cursors = logs.select("topic").distinct().where(n < 200).select("topic", (n % 3).alias("from_seq"))
    return R.watch_batches(logs.withColumn("node", F.col("tag")), cursors, 4, 900, nodes="system")


@query(f"WITH {EV} SELECT node AS session, max(ts_ms) AS idle_since_ms FROM ev GROUP BY node HAVING count(*) % 2 = 0 AND max(ts_ms) < 1706659000000 - 300000")
def idle_sessions(spark, sf_dir):
    rows = events_log(spark, sf_dir).groupBy(F.col("node").alias("session")).agg((F.count("*") % 2).alias("streams"), F.max("ts_ms").alias("idle_since_ms"))
    return R.idle_sessions(rows, 1_706_659_000_000).select("session", "idle_since_ms")


# --- scheduling --------------------------------------------------------------------------------------------------

PRIO = """pr AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(user_id * 17 - 400 AS INTEGER) END AS manual, event_id % 3 <> 0 AS auto, (event_id * 977) % 400000 AS idle_ms, (event_id * 131) % 20000 AS waited_ms FROM events),
ep AS (SELECT event_id, CAST(round(coalesce(CAST(greatest(-1000, least(1000, manual)) AS DOUBLE), CASE WHEN auto AND idle_ms <= 300000 THEN 500.0 * pow(2.0, -idle_ms / CAST(30000.0 AS DOUBLE)) ELSE 0.0 END) + CAST(0.1 AS DOUBLE) * least(waited_ms, 10000)) AS BIGINT) AS priority, waited_ms FROM pr)"""


def _priorities(spark, sf_dir):
    i = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", F.when(i % 3 == 0, F.col("user_id") * 17 - 400).cast("int").alias("manual"), (i % 3 != 0).alias("auto"), ((i * 977) % 400000).alias("idle_ms"), ((i * 131) % 20000).alias("waited_ms"))
    return rows.select("event_id", X.effective_priority(F.col("manual"), F.col("auto"), F.col("idle_ms"), F.col("waited_ms")).alias("priority"), "waited_ms")


@query(f"WITH {PRIO} SELECT event_id, priority FROM ep")
def effective_priority(spark, sf_dir):
    return _priorities(spark, sf_dir).select("event_id", "priority")


BAND = "CASE WHEN priority >= 750 THEN 4 WHEN priority >= 500 THEN 3 WHEN priority >= 250 THEN 2 WHEN priority >= 0 THEN 1 ELSE 0 END"


@query(
    f"""WITH {PRIO}, u AS (SELECT 'u' || e.user_id AS topic, max(ep.priority) AS priority, min(ep.waited_ms) AS enqueued_ms FROM ep JOIN events e ON ep.event_id = e.event_id GROUP BY e.user_id),
    s AS (SELECT topic, {BAND} AS band, enqueued_ms FROM u) SELECT topic, band, enqueued_ms, CAST(row_number() OVER (ORDER BY band DESC, enqueued_ms, topic) AS INTEGER) AS turn FROM s"""
)
def priority_bands(spark, sf_dir):
    """Every user's log is a source with work."""
    users = table(spark, sf_dir, "events").select("event_id", "user_id")
    rows = _priorities(spark, sf_dir).join(users, "event_id").groupBy(F.concat(F.lit("u"), F.col("user_id")).alias("topic")).agg(F.max("priority").alias("priority"), F.min("waited_ms").alias("enqueued_ms"))
    return O.drain_order(rows.select("topic", X.priority_band(F.col("priority")).alias("band"), "enqueued_ms"))


# --- the flagship ------------------------------------------------------------------------------------------------


@query(
    f"""WITH {EV}, c AS (SELECT greatest(max(seq) - 800, {EXPIRY}) AS gone FROM ev),
    d AS (SELECT ev.*, row_number() OVER (ORDER BY seq) AS rn, sum(bytes) OVER (ORDER BY seq) AS cum FROM ev, c WHERE seq > gone AND node <> 'u3')
    SELECT topic, seq, ts_ms, node, tag, data, bytes FROM d WHERE rn <= 256 AND (rn = 1 OR cum <= {1 << 20})"""
)
def diff_page(spark, sf_dir):
    """One page of a log with a records cap and a time to live, read from the start: it resumes after what was lost."""
    gone = T.floors(events_log(spark, sf_dir), NOW, ttl_ms=TTL, cap_records=800).select(F.greatest(*T.FLOORS).alias("gone")).first()
    start = gone["gone"] if gone else 0  # a row for the one log; its floor reaches the scan
    return R.diff_page(events_log(spark, sf_dir, start), start, nodes="u3", tags=True)


# --- bodies, frames, sockets -------------------------------------------------------------------------------------


@query(f"""WITH {EV} SELECT (seq - 1) // 100 AS request, (seq - 1) % 100 AS pos, replace(data, ' ', '') AS data, CASE WHEN seq % 3 <> 0 THEN tag END AS tag, CASE WHEN seq % 4 = 0 THEN 'n' || (seq - 1) // 100 ELSE node END AS node,
    CASE WHEN seq % 5 = 0 THEN '{{"a":' || seq || '}}' END AS meta, CAST(NULL AS VARCHAR) AS problem FROM ev WHERE (seq - 1) // 100 % 10 <> 7
    UNION ALL SELECT DISTINCT (seq - 1) // 100, CAST(NULL AS BIGINT), NULL, NULL, NULL, NULL, 'malformed JSON body' FROM ev WHERE (seq - 1) // 100 % 10 = 7""")  # fmt: skip
def json_bodies(spark, sf_dir):
    """Events in bodies of a hundred records; each tenth body is cut short."""
    s = F.col("seq")
    rec = F.struct(F.expr("parse_json(data)").alias("data"), F.when(s % 3 != 0, F.col("tag")).alias("tag"), F.when(s % 4 != 0, F.col("node")).alias("node"), F.when(s % 5 == 0, F.struct(s.alias("a"))).alias("meta"))
    rows = events_log(spark, sf_dir).select(F.expr("(seq - 1) DIV 100").alias("request"), F.struct(s, F.to_json(rec).alias("j")).alias("r"))
    rows = rows.groupBy("request").agg(F.sort_array(F.collect_list("r")).alias("r"))
    body = F.concat(F.lit('{"records":['), F.array_join(F.col("r.j"), ","), F.lit('],"node":"n'), F.col("request").cast("string"), F.lit('"}'))
    return B.parsed(rows.select("request", F.when(F.col("request") % 10 == 7, F.substring(body, 1, 50)).otherwise(body).alias("body")))


READERS = "VALUES ('a', 'u1', 0, true, false), ('b', 'u1', 5, true, false), ('c', 'u1', 2, false, true), ('d', 'u2', 0, true, true), ('e', 'u2', 3, false, false)"


@query(
    f"""WITH {EV}, ul AS (SELECT node AS topic, row_number() OVER (PARTITION BY node ORDER BY seq) AS seq, ts_ms, node, tag, data FROM ev),
    rd(reader, topic, from_seq, d, t) AS ({READERS})
    SELECT reader, rd.topic, seq, '{{"$seq":' || seq || ',"$ts":' || ts_ms || ',"$node":"' || node || '"' || CASE WHEN t THEN ',"$tag":"' || tag || '"' ELSE '' END || CASE WHEN d THEN ',"data":' || data ELSE '' END || '}}' AS frame
    FROM rd JOIN ul ON rd.topic = ul.topic AND seq > from_seq"""
)
def shared_frames(spark, sf_dir):
    return B.shared_frames(user_logs(spark, sf_dir), spark.sql(f"SELECT * FROM {READERS} AS t(reader, topic, from_seq, include_data, include_tags)"))


SOCKET = f"""{EV}, co AS (SELECT node AS socket, seq AS pos, CASE seq % 7 WHEN 0 THEN 'ping' WHEN 1 THEN 'subscribe' WHEN 2 THEN 'subscribe' WHEN 3 THEN 'unsubscribe' WHEN 6 THEN 'leave' ELSE 'publish' END AS op,
    CASE WHEN seq % 11 > 0 THEN CASE WHEN seq % 13 = 0 THEN 'x' || seq ELSE tag END END AS topic, seq % 20 AS from_seq, seq % 7 = 2 AS tail, seq % 4 AS records FROM ev),
  ru AS (SELECT *, sum(CASE WHEN op = 'publish' THEN records ELSE 0 END) OVER (PARTITION BY topic ORDER BY pos) AS upto FROM co),
  st AS (SELECT *, CAST(upto + CASE WHEN topic IN ('click', 'view') THEN 1000 ELSE 0 END AS BIGINT) AS hd, upto > 0 OR topic IN ('click', 'view') AS there FROM ru),
  er AS (SELECT *, CASE WHEN op = 'leave' OR (op = 'publish' AND topic IS NULL) THEN 'invalid_json' WHEN (op IN ('subscribe', 'unsubscribe') AND topic IS NULL) OR (op = 'publish' AND records = 0) THEN 'invalid_request'
    WHEN op = 'subscribe' AND NOT there THEN 'topic_not_found' END AS code FROM st),
  re AS (SELECT socket, pos, CASE WHEN code IS NOT NULL THEN 'error' WHEN op = 'subscribe' THEN 'subscribed' WHEN op = 'unsubscribe' THEN 'unsubscribed' WHEN op = 'publish' THEN 'ack' ELSE 'pong' END AS reply, topic,
    CASE WHEN code IS NULL AND op = 'subscribe' THEN CASE WHEN tail THEN hd ELSE from_seq END END AS from_seq, CASE WHEN code IS NULL AND op = 'publish' THEN hd - records + 1 END AS first_seq, CASE WHEN code IS NULL AND op = 'publish' THEN hd END AS last_seq, code FROM er)"""


def _replies(spark, sf_dir):
    s = F.col("seq")
    op = F.expr("CASE seq % 7 WHEN 0 THEN 'ping' WHEN 1 THEN 'subscribe' WHEN 2 THEN 'subscribe' WHEN 3 THEN 'unsubscribe' WHEN 6 THEN 'leave' ELSE 'publish' END")
    topic = F.when(s % 11 > 0, F.when(s % 13 == 0, F.concat(F.lit("x"), s.cast("string"))).otherwise(F.col("tag")))
    commands = events_log(spark, sf_dir).select(F.col("node").alias("socket"), s.alias("pos"), op.alias("op"), topic.alias("topic"), (s % 20).alias("from_seq"), (s % 7 == 2).alias("tail"), (s % 4).alias("records"))
    return S.replies(commands, spark.sql("SELECT * FROM VALUES ('click', 1000L), ('view', 1000L) AS t(topic, head)"))


@query(f"WITH {SOCKET} SELECT * FROM re")
def socket_replies(spark, sf_dir):
    """Every event is a command of its user's socket."""
    return _replies(spark, sf_dir)


@query(f"""WITH {SOCKET}, la AS (SELECT *, row_number() OVER (PARTITION BY socket, topic ORDER BY pos DESC) AS n FROM re WHERE reply IN ('subscribed', 'unsubscribed'))
    SELECT socket, topic, from_seq FROM la WHERE n = 1 AND reply = 'subscribed'""")
def socket_subscriptions(spark, sf_dir):
    return S.subscriptions(_replies(spark, sf_dir))


@query(f"WITH {EV}, q AS (SELECT node AS socket, ts_ms AS sent_ms, coalesce(lead(ts_ms) OVER (PARTITION BY node ORDER BY ts_ms), {NOW}) - ts_ms AS quiet FROM (SELECT DISTINCT node, ts_ms FROM ev)) SELECT socket, sent_ms, greatest(quiet - 1, 0) // 60000 AS beats FROM q")
def heartbeats(spark, sf_dir):
    """A frame for each event; the wait asked for is longer than the longest there is."""
    return S.heartbeats(events_log(spark, sf_dir).select(F.col("node").alias("socket"), F.col("ts_ms").alias("sent_ms")).distinct(), 90_000, NOW)


@query(
    f"""WITH RECURSIVE {EV}, w AS (SELECT node AS topic, seq AS pos, ts_ms // 10000 AS at_ms FROM ev),
    s AS (SELECT topic, min(pos) AS leader FROM w GROUP BY topic
      UNION ALL SELECT s.topic, (SELECT min(n.pos) FROM w n JOIN w o ON o.pos = s.leader WHERE n.topic = s.topic AND n.pos > s.leader AND n.at_ms - o.at_ms >= 5000) FROM s WHERE s.leader IS NOT NULL),
    a AS (SELECT w.*, max(s.leader) OVER (PARTITION BY w.topic ORDER BY pos) AS leader FROM w LEFT JOIN s ON w.pos = s.leader)
    SELECT a.topic, a.pos, a.at_ms, a.leader, l.at_ms + 5000 AS served_ms FROM a JOIN w l ON l.pos = a.leader"""
)
def claim_windows(spark, sf_dir):
    """Every event is a claim of its user's queue; the wait asked for is longer than the longest there is."""
    claims = events_log(spark, sf_dir).select(F.col("node").alias("topic"), F.col("seq").alias("pos"), F.expr("ts_ms DIV 10000").alias("at_ms"))
    return Q.claim_windows(claims, 9_000)


@query(f"WITH {OR}, {LEASES}, {FOLD} SELECT seq, 'released' AS event, node, lease_id, CAST(NULL AS BIGINT) AS deadline_ms, CAST(NULL AS BIGINT) AS ready_at_ms, CAST({AT} AS BIGINT) AS ts_ms FROM ls WHERE leased AND node = 'w1'")
def release_connection(spark, sf_dir):
    """Workers have a connection each; one is gone."""
    events = _lease_events(orders_queue(spark, sf_dir)).withColumn("connection", F.col("node"))
    return Q.release_connection(Q.lease_fold(events, AT), "w1", AT)


# --- streams -----------------------------------------------------------------------------------------------------


@query(f"WITH {EV} SELECT topic, 'record' AS kind, seq, tag FROM ev WHERE seq > 100 AND (node IS NULL OR node NOT IN ('u1', 'u2')) UNION ALL SELECT topic, 'caught_up', max(seq), NULL FROM ev GROUP BY topic")
def stream_watch(spark, sf_dir):
    heads = events_log(spark, sf_dir).groupBy("topic").agg(F.max("seq").alias("head"))
    return L.watch(L.event_stream(spark, sf_dir), L.work_folder(spark, "watch"), 100, ["u1", "u2"], heads)


@query(
    f"""WITH {EV} SELECT 'mirror' AS topic, row_number() OVER (ORDER BY seq) AS seq, {NOW} AS ts_ms, node, tag, data, bytes, 1 AS hops, seq AS source_seq, ':events:' || seq AS source_key
    FROM ev WHERE starts_with(tag, 'pur')"""
)
def stream_router(spark, sf_dir):
    return L.route(L.event_stream(spark, sf_dir), L.work_folder(spark, "router"), "mirror", NOW, match="pur*")


@query(
    f"""WITH RECURSIVE {EV}, e AS (SELECT seq % 8 AS connection, seq, ts_ms, row_number() OVER (PARTITION BY seq % 8 ORDER BY seq) AS n FROM ev),
    s AS (SELECT connection, n, seq, ts_ms AS pushed_ms, [ts_ms + 3600000] AS held FROM e WHERE n = 1
      UNION ALL SELECT connection, n, seq, pushed, list_append(rest, pushed + 3600000) FROM (
        SELECT connection, n, seq, CASE WHEN len(h) >= 4 THEN h[1] + 1 ELSE ts_ms END AS pushed, CASE WHEN len(h) >= 4 THEN h[2:] ELSE h END AS rest FROM (
          SELECT e.connection, e.n, e.seq, e.ts_ms, list_sort(list_filter(s.held, lambda x: x >= e.ts_ms)) AS h FROM s JOIN e ON e.connection = s.connection AND e.n = s.n + 1)))
    SELECT connection, seq, pushed_ms + 3600000 AS lease_until, pushed_ms FROM s"""
)
def stream_queue(spark, sf_dir):
    return L.pushed(L.event_stream(spark, sf_dir), L.work_folder(spark, "queue"), 8, 4, 3_600_000)


@query(
    f"""WITH RECURSIVE {EV}, w AS (SELECT seq, node || ':' || tag AS idem_key, ts_ms FROM ev),
    s AS (SELECT idem_key, min(seq) AS seq FROM w GROUP BY idem_key
      UNION ALL SELECT s.idem_key, (SELECT min(n.seq) FROM w n JOIN w o ON o.seq = s.seq WHERE n.idem_key = s.idem_key AND n.seq > s.seq AND n.ts_ms - o.ts_ms > 86400000) FROM s WHERE s.seq IS NOT NULL),
    a AS (SELECT w.*, s.seq IS NOT NULL AS accepted FROM w LEFT JOIN s ON w.seq = s.seq)
    SELECT idem_key, seq, accepted, max(CASE WHEN accepted THEN seq END) OVER (PARTITION BY idem_key ORDER BY seq) AS original_seq FROM a"""
)
def stream_dedupe(spark, sf_dir):
    rows = L.event_stream(spark, sf_dir).withColumn("idem_key", F.concat_ws(":", "node", "tag"))
    return L.deduplicated(rows, L.work_folder(spark, "dedupe"), 86_400_000)
