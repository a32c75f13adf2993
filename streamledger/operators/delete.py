"""Deletes as control rows; what lives is derived. A delete is pinned to the head at its time, so later writes stay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import LedgerError
from ..functions.exprs import TagFilter

CONTROL = "pos long, topic string, before_seq long, match_op string, match_value string, bound_head long, seqs array<long>"


def delete_row(pos: int, topic: str, head: int, before_seq: int | None = None, match=None, seqs: list[int] | None = None) -> tuple:
    """The control row of a delete; it needs before_seq, match or seqs."""
    if before_seq is None and match is None and seqs is None:
        raise LedgerError("invalid_request", "a delete needs before_seq or match")
    f = TagFilter.parse(match) if match is not None else None
    return pos, topic, before_seq, f and f.op, f and f.value, head + 1, seqs


def live_records(log: DataFrame, control: DataFrame) -> DataFrame:
    """Records that no control row deletes.

    Prefix deletes fold to one bound a topic. Tag deletes fold to one bound for each tag there is: prefixes are matched
    against distinct tags, not against records. Explicit sets are an anti join.
    """
    bound = F.least(F.coalesce("before_seq", "bound_head"), "bound_head")
    below = control.where("match_op IS NULL AND seqs IS NULL").groupBy("topic").agg(F.max(bound).alias("below"))
    rules = control.where("match_op IS NOT NULL").groupBy("topic", "match_op", "match_value").agg(F.max(bound).alias("bound"))
    tags = log.where("tag IS NOT NULL").select("topic", "tag").distinct()
    same = tags.join(rules.where("match_op = 'Eq'").select("topic", F.col("match_value").alias("tag"), "bound"), ["topic", "tag"])
    # a prefix rule meets the tags' own beginnings of its length: a tag has as many as there are lengths of rules, 256 at most
    prefixes = rules.where("match_op <> 'Eq'").select("topic", F.length("match_value").alias("n"), F.col("match_value").alias("begin"), "bound")
    begins = tags.join(prefixes.select("topic", "n").distinct(), "topic").where(F.length("tag") >= F.col("n")).withColumn("begin", F.expr("substring(tag, 1, n)"))
    by_tag = same.union(begins.join(prefixes, ["topic", "n", "begin"]).select("topic", "tag", "bound")).groupBy("topic", "tag").agg(F.max("bound").alias("tag_below"))
    sets = control.where("seqs IS NOT NULL").select("topic", F.explode("seqs").alias("seq")).distinct()
    out = log.join(below, "topic", "left").join(by_tag, ["topic", "tag"], "left")
    out = out.where("NOT coalesce(seq < below, false) AND NOT coalesce(seq < tag_below, false)").join(sets, ["topic", "seq"], "left_anti")
    return out.select(*log.columns)


def delete_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row a topic: deleted, earliest_seq, head, count, bytes. ``before`` are the live records until then."""
    had = before.groupBy("topic").agg(F.max("seq").alias("head"), F.count("*").alias("had"))
    has = after.groupBy("topic").agg(F.min("seq").alias("first"), F.count("*").alias("n"), F.sum("bytes").cast("long").alias("b"))
    out = had.join(has, "topic", "left")
    return out.select("topic", (F.col("had") - F.coalesce("n", F.lit(0))).alias("deleted"), F.coalesce("first", F.col("head") + 1).alias("earliest_seq"), "head", F.coalesce("n", F.lit(0)).alias("count"), F.coalesce("b", F.lit(0)).alias("bytes"))
