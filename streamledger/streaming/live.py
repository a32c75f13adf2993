"""Push side: streams over log files with the batch operators inside each micro-batch.

Sinks are idempotent: a micro-batch writes a folder named after its number, so one that runs again
after a failure replaces its own rows.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import config as C
from ..functions.exprs import TagFilter, node_passes

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one the cluster names; under the warehouse where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, sf_dir: str, files_per_batch: int = 1) -> DataFrame:
    """The events table as a stream of log records."""
    rows = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(f"{sf_dir}/event[s].parquet")
    return rows.select(
        F.lit("events").alias("topic"), (F.col("event_id") + 1).alias("seq"), F.expr("unix_micros(CAST(ts AS TIMESTAMP)) DIV 1000").alias("ts_ms"),
        F.concat(F.lit("u"), F.col("user_id")).alias("node"), F.col("event_type").alias("tag"), F.col("props").alias("data"), F.octet_length("props").cast("long").alias("bytes"))


def run_available(stream: DataFrame, folder: str, batch=None, mode: str = "append", after=None) -> DataFrame:
    """Run what is available to the end and return what was written. ``batch`` turns a micro-batch into the rows of the sink; ``after`` sees what it wrote."""
    spark = stream.sparkSession

    def write(df: DataFrame, number: int) -> None:
        rows = batch(df, number) if batch else df
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        if after:
            after(spark.read.schema(rows.schema).parquet(f"{folder}/rows/batch={number}"), number)

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.option("basePath", f"{folder}/rows").parquet(f"{folder}/rows/*").drop("batch")


def watch(stream: DataFrame, folder: str, from_seq: int = 0, nodes=(), heads: DataFrame | None = None) -> DataFrame:
    """Frames of a watch: each record after the cursor that passes, and caught_up with the true head when a log has been drained to it.

    What is filtered counts for the head, so a reader of whose records none passes catches up too. ``heads`` (topic, head) says
    where the logs end while there is a backlog; without it a micro-batch is what there is.
    """

    def frames(df: DataFrame, number: int) -> DataFrame:
        rows = df.where(F.col("seq") > from_seq).where(node_passes(nodes))
        records = rows.select("topic", F.lit("record").alias("kind"), "seq", "tag")
        caught = df.groupBy("topic").agg(F.max("seq").alias("seq"))
        if heads is not None:
            caught = caught.join(heads, "topic").where("seq >= head").select("topic", "seq")
        return records.union(caught.select("topic", F.lit("caught_up").alias("kind"), "seq", F.lit(None).cast("string").alias("tag")))

    return run_available(stream, folder, frames)


def route(stream: DataFrame, folder: str, dest: str, now_ms: int, match=None, preserve_node: bool = True, preserve_tag: bool = True) -> DataFrame:
    """A router as a stream: filtered records get the destination's next numbers, micro-batch by micro-batch.

    The head is kept with each micro-batch, so that one that runs again gets its old numbers.
    """
    from ..operators.router import forward

    rows = stream.where(TagFilter.parse(match).column()) if match is not None else stream
    spark = stream.sparkSession

    def head(number: int) -> int:
        return spark.read.schema("head long").parquet(f"{folder}/heads/batch={number}").first()[0] if number >= 0 else 0

    def arrive(df: DataFrame, number: int) -> DataFrame:
        return forward(df, dest, head(number - 1), now_ms, preserve_node=preserve_node, preserve_tag=preserve_tag)

    def keep(out: DataFrame, number: int) -> None:
        last = out.agg(F.max("seq")).first()[0] or head(number - 1)
        spark.createDataFrame([(last,)], "head long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/heads/batch={number}")

    return run_available(rows, folder, arrive, after=keep)


def deduplicated(stream: DataFrame, folder: str, window_ms: int) -> DataFrame:
    """Idempotent writes (idem_key, seq, ts_ms) as keyed state: (idem_key, seq, accepted, original_seq). Exact: a retry doesn't extend the window."""

    def run(key, frames, state: GroupState):
        created, first = state.get if state.exists else (None, None)
        rows = pd.concat(list(frames)).sort_values("seq")
        accepted, original = [], []
        for seq, ts in zip(rows["seq"], rows["ts_ms"], strict=True):
            new = created is None or ts - created > window_ms
            if new:
                created, first = int(ts), int(seq)
            accepted.append(new)
            original.append(first)
        state.update((created, first))
        yield pd.DataFrame({"idem_key": key[0], "seq": rows["seq"], "accepted": accepted, "original_seq": original})

    rows = stream.select("idem_key", "seq", "ts_ms").groupBy("idem_key")
    out = rows.applyInPandasWithState(run, "idem_key string, seq long, accepted boolean, original_seq long", "created long, first long", "append", GroupStateTimeout.NoTimeout)
    return run_available(out, folder)


def pushed(stream: DataFrame, folder: str, connections: int, most: int, lease_ms: int = 30_000) -> DataFrame:
    """Push mode: each connection holds at most ``most`` leases; a record is pushed when an earlier lease of its connection has ended.

    Rows: (connection, seq, lease_until, pushed_ms). Time is the record's own; a lease ends at its deadline. State is kept for each connection.
    """
    lease = max(C.LEASE_MS_MIN, min(lease_ms, C.LEASE_MS_MAX))

    def run(key, frames, state: GroupState):
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values("seq")
        at, until = [], []
        for ts in rows["ts_ms"]:
            now = int(ts)
            held = [h for h in held if h >= now]
            if len(held) >= most:
                held.sort()
                now = held.pop(0) + 1
            held.append(now + lease)
            at.append(now)
            until.append(now + lease)
        state.update((held,))
        yield pd.DataFrame({"connection": key[0], "seq": rows["seq"], "lease_until": until, "pushed_ms": at})

    rows = stream.withColumn("connection", F.pmod("seq", F.lit(connections))).select("connection", "seq", "ts_ms").groupBy("connection")
    out = rows.applyInPandasWithState(run, "connection long, seq long, lease_until long, pushed_ms long", "held array<long>", "append", GroupStateTimeout.NoTimeout)
    return run_available(out, folder)
