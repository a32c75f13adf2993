"""A socket's commands: subscribe, unsubscribe, publish, ping. What a socket watches is a fold of what it was told.

commands: socket, pos (unique, in order of arrival), op, topic, from_seq, tail, records (of a publish).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import HEARTBEAT_MS
from .append import prefix_sums


def replies(commands: DataFrame, heads: DataFrame) -> DataFrame:
    """(socket, pos, reply, topic, from_seq, first_seq, last_seq, code): one answer to each command.

    ``heads`` (topic, head): the logs before the first command. A publish creates its log and gets the next numbers; a subscription starts at
    from_seq or, with tail, at the head of its moment. Errors: invalid_json for an op that there isn't or a publish without topic, invalid_request for
    a command without topic or a publish of nothing, topic_not_found for a subscription to a log that isn't there.
    """
    c = commands.withColumn("from_seq", F.coalesce("from_seq", F.lit(0)).cast("long")).withColumn("records", F.coalesce("records", F.lit(0)).cast("long"))
    op, none = F.col("op"), F.lit(None).cast("long")
    named = c.where("topic IS NOT NULL").withColumn("n", F.when((op == "publish") & (F.col("records") > 0), F.col("records")).otherwise(0))
    named = prefix_sums(named.withColumn("own", F.col("n")), ["topic"], "pos", "n", "upto").join(heads, "topic", "left")
    named = named.withColumn("at", F.coalesce("head", F.lit(0)) + F.col("upto")).withColumn("there", F.col("head").isNotNull() | (F.col("upto") > 0)).drop("head", "upto", "n")
    free = c.where("topic IS NULL").withColumn("own", none).withColumn("at", none).withColumn("there", F.lit(False))
    rows = named.unionByName(free)
    lost = F.col("topic").isNull()
    code = (
        F.when(~F.coalesce(op.isin("subscribe", "unsubscribe", "publish", "ping"), F.lit(False)) | ((op == "publish") & lost), "invalid_json")
        .when((op.isin("subscribe", "unsubscribe") & lost) | ((op == "publish") & (F.col("records") <= 0)), "invalid_request")
        .when((op == "subscribe") & ~F.col("there"), "topic_not_found")
    )
    rows = rows.withColumn("code", code)
    done = F.col("code").isNull()
    reply = F.when(~done, "error").when(op == "subscribe", "subscribed").when(op == "unsubscribe", "unsubscribed").when(op == "publish", "ack").otherwise("pong")
    start = F.when(done & (op == "subscribe"), F.when(F.coalesce("tail", F.lit(False)), F.col("at")).otherwise(F.col("from_seq")))
    wrote = done & (op == "publish")
    return rows.select("socket", "pos", reply.alias("reply"), "topic", start.alias("from_seq"), F.when(wrote, F.col("at") - F.col("own") + 1).alias("first_seq"), F.when(wrote, F.col("at")).alias("last_seq"), "code")


def subscriptions(answered: DataFrame) -> DataFrame:
    """(socket, topic, from_seq) that are on after all ``replies``: the last answer about a socket's topic counts."""
    about = answered.where("reply IN ('subscribed', 'unsubscribed')")
    last = about.groupBy("socket", "topic").agg(F.max_by(F.struct("reply", "from_seq"), "pos").alias("l"))
    return last.where("l.reply = 'subscribed'").select("socket", "topic", "l.from_seq")


def heartbeats(frames: DataFrame, heartbeat_ms: int, until_ms: int) -> DataFrame:
    """(socket, sent_ms, beats): heartbeats after each frame (``frames``: socket, sent_ms, unique) until the next, or until ``until_ms``; each frame starts the wait anew."""
    beat = max(HEARTBEAT_MS[0], min(heartbeat_ms, HEARTBEAT_MS[1]))
    after = F.lead("sent_ms", 1, until_ms).over(Window.partitionBy("socket").orderBy("sent_ms"))
    quiet = frames.select("socket", "sent_ms", (after - F.col("sent_ms")).alias("quiet"))
    return quiet.select("socket", "sent_ms", F.expr(f"CAST(greatest(quiet - 1, 0) DIV {beat} AS BIGINT)").alias("beats"))
