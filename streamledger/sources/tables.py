"""The driver's tables as logs: (topic, seq, ts_ms, node, tag, data, bytes)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder the cluster names (the warehouse where none is set): it cuts the lineage and is computed once."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{root.rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_log(spark: SparkSession, sf_dir: str, from_seq: int = 0, to_seq: int | None = None) -> DataFrame:
    """``from_seq`` (exclusive) and ``to_seq`` (inclusive) become bounds of event_id, so that they reach the scan."""
    rows = table(spark, sf_dir, "events")
    if from_seq > 0:
        rows = rows.where(F.col("event_id") >= from_seq)
    if to_seq is not None:
        rows = rows.where(F.col("event_id") < to_seq)
    ts = F.expr("unix_micros(CAST(ts AS TIMESTAMP)) DIV 1000")
    return rows.select(
        F.lit("events").alias("topic"), (F.col("event_id") + 1).alias("seq"), ts.alias("ts_ms"), F.concat(F.lit("u"), F.col("user_id")).alias("node"),
        F.col("event_type").alias("tag"), F.col("props").alias("data"), F.octet_length("props").cast("long").alias("bytes"))


def user_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A topic for each user; seq is dense in it."""
    from ..operators.append import assign_seq

    rows = events_log(spark, sf_dir).drop("topic").withColumnRenamed("seq", "pos").withColumn("topic", F.col("node"))
    return assign_seq(rows, ["topic"], ["pos"])


def orders_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.lit("orders").alias("topic"), (F.col("o_orderkey") + 1).alias("seq"), F.expr("unix_micros(CAST(o_orderdate AS TIMESTAMP)) DIV 1000").alias("ts_ms"),
        F.concat(F.lit("c"), F.col("o_custkey")).alias("node"), F.col("o_orderpriority").alias("tag"), F.col("o_orderstatus").alias("data"), F.octet_length("o_orderstatus").cast("long").alias("bytes"))


def conversation_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A topic for each conversation."""
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("conv:"), F.col("conv_id")).alias("topic"), (F.col("turn") + 1).alias("seq"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ts_ms"),
        F.lit(None).cast("string").alias("node"), F.col("role").alias("tag"), F.col("text").alias("data"), F.octet_length("text").cast("long").alias("bytes"))
