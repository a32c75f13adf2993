"""Connected components by alternating large-star and small-star contraction, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import discard, materialize, spread


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(id, component) of every node with an edge to another; component is the smallest id reachable.

    Null ends and loops are ignored, repeated edges count once, no edges give no rows. Every round
    replaces the edges by a smaller-or-equal set that keeps the components (a node's neighbours are
    joined to the smallest of them), written to the shared scratch folder. Minima are aggregated before
    they are joined back, dealt anew: so the centre of a huge star is a plain skewed join, which is split at run time, never one task's list.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    e = materialize(e, "edges")

    def mark(d: DataFrame):
        return d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = mark(e)
    for _ in range(max_rounds):
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(e.select("v", "u"))
        low = spread(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")))
        large = both.where("y > x").join(low, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        least = spread(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        done, e = e, materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(done)
        now = mark(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v")).distinct())
