"""Sharding by extendible hashing, in DataFrame operations only.

A directory is indexed by the leading bits of a document's hash. Starting from depth 0, only buckets over the byte limit split on
one more bit, until every shard fits. A bucket splits exactly if the bytes under its prefix exceed the limit, and bytes
only fall with depth; so a document's shard is the shortest of its prefixes that fits.

Each round sums bytes by a prefix of some more bits (partial sums before the shuffle) and derives the levels
above from these sums: how many of a long prefix's levels are over the limit is how many bits it needs. The first round
takes as many bits as the total asks for; only buckets that are still too large go to the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import materialize, partitions

STEP = 12  # bits of the rounds after the first
DEPTH = 60  # bits of the hash
SMALL = 1 << 14  # prefixes that may be broadcast


def _bits(key: Column) -> Column:
    """Sixty bits of the key's MD5, a hash that SQL engines share."""
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def extendible_shards(docs: DataFrame, limit: int, key: str = "doc_id", size: Column | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep columns, bytes, depth, prefix: the leading ``depth`` bits, part, shard: their name) of every row.

    ``size`` is a row's bytes, by default those of its text in UTF-8 (null: 0). A row over the limit has a shard of its own kind: its
    bucket can't fit and ends at full depth. Rows of one key share all bits; if these alone exceed the limit, they
    go to parts of the full-depth bucket, filled in order of size, each within the limit unless one row exceeds it.
    A null key hashes as the empty text. An empty table gives no rows. A result's column has an underscore before its name where
    ``keep`` has one of that name.
    """
    if limit < 1:
        raise ValueError("limit has to be positive")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") if size is None else size
    rows = docs.select(F.struct(*keep).alias("_keep"), _bits(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")).alias("_bits"), size.alias("_bytes"))
    pending = materialize(rows, "shard-rows")
    total = pending.agg(F.sum("_bytes")).first()[0] or 0
    start, step = 0, min(24, max(8, (-(-total // limit)).bit_length() + 4))
    placed: list[DataFrame] = []
    while True:
        shift = DEPTH - start - step
        long_prefix = F.shiftright("_bits", shift)
        sums = pending.groupBy(long_prefix.alias("long_prefix")).agg(F.sum("_bytes").alias("b"))
        levels = sums.select("long_prefix", "b", F.explode(F.sequence(F.lit(0), F.lit(step))).alias("up"))
        levels = levels.withColumn("p", F.expr("shiftright(long_prefix, up)"))
        over = levels.groupBy("up", "p").agg(F.sum("b").alias("b")).where(F.col("b") > limit).select("up", "p")
        need = levels.join(over, ["up", "p"], "left_semi").groupBy("long_prefix").agg(F.count("*").cast("int").alias("over"))
        need = materialize(sums.select("long_prefix").join(need, "long_prefix", "left").fillna(0, ["over"]), "directory")
        directory = F.broadcast(need) if 1 << (start + step) <= SMALL else need
        met = pending.withColumn("long_prefix", long_prefix).join(directory, "long_prefix").drop("long_prefix")
        depth = (F.col("over") + start).cast("int")
        placed.append(met.where(f"over <= {step}").withColumn("depth", depth).drop("over").withColumn("part", F.lit(0).cast("long")))
        left = need.where(f"over > {step}")
        if not left.take(1):
            break
        start += step
        pending = materialize(met.where(f"over > {step}").drop("over"), "oversize")
        if start >= DEPTH:
            # what no number of bits splits: repeated keys over the limit, and single rows over it
            placed.append(_parts(pending, limit).select(*placed[0].columns))
            break
        step = min(STEP, DEPTH - start)
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    out = out.withColumn("prefix", F.expr(f"CASE WHEN depth = 0 THEN 0L ELSE shiftright(_bits, {DEPTH} - depth) END"))
    name = F.concat_ws("-", F.lpad(F.col("depth").cast("string"), 2, "0"), F.lower(F.hex("prefix")), F.col("part").cast("string"))
    out = out.select("_keep", F.col("_bytes").alias("bytes"), "depth", "prefix", "part", name.alias("shard"))
    return out.select("_keep.*", *(F.col(c).alias(f"_{c}" if c in keep else c) for c in out.columns[1:]))


def _parts(rows: DataFrame, limit: int) -> DataFrame:
    """Rows of keys that hold more than the limit, in numbered parts: the largest first, as many a part as its key's largest allows.

    Rows are dealt by key, size and their place in the table, so that a hot key lies in many slices; a row's number is its place in the slice
    and what the key has in the slices before. The slices are written, so that numbers stay when a task runs again.
    """
    order = [F.col("_bits"), F.desc("_bytes"), F.col("_at")]
    dealt = rows.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(partitions(rows.sparkSession), *order)
    slices = materialize(dealt.withColumn("_slice", F.spark_partition_id()), "slices")
    key = Window.partitionBy("_bits")  # a row for each slice of the key
    counts = slices.groupBy("_bits", "_slice").agg(F.count("*").alias("_n"), F.max("_bytes").alias("_top"))
    room = F.greatest(F.floor(F.lit(limit) / F.greatest(F.max("_top").over(key), F.lit(1))), F.lit(1))
    counts = counts.select("_bits", "_slice", (F.sum("_n").over(key.orderBy("_slice")) - F.col("_n")).alias("_before"), room.alias("_room"))
    place = F.row_number().over(Window.partitionBy("_bits", "_slice").orderBy(F.desc("_bytes"), "_at"))
    met = slices.withColumn("_place", place).join(counts, ["_bits", "_slice"])
    return met.withColumn("depth", F.lit(DEPTH)).withColumn("part", F.floor((F.col("_before") + F.col("_place") - 1) / F.col("_room")).cast("long"))


SHARD_BYTES = 1 << 20


def op4_extendible_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in shards of at most 1 MiB of text."""
    out = extendible_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), SHARD_BYTES)
    return out.select("doc_id", "bytes", "depth", "prefix", "part")


OP4_SQL = f"""
WITH r AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes,
    CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS bits FROM documents),
l AS (SELECT doc_id, bytes, bits, unnest(range(0, {DEPTH + 1})) AS depth FROM r),
p AS (SELECT doc_id, bytes, depth, bits >> CAST({DEPTH} - depth AS BIGINT) AS prefix FROM l),
s AS (SELECT depth, prefix, sum(bytes) AS b FROM p GROUP BY depth, prefix)
SELECT p.doc_id, any_value(p.bytes) AS bytes, CAST(min(p.depth) AS INTEGER) AS depth, arg_min(p.prefix, p.depth) AS prefix, CAST(0 AS BIGINT) AS part
FROM p JOIN s ON p.depth = s.depth AND p.prefix = s.prefix WHERE s.b <= {SHARD_BYTES} GROUP BY p.doc_id
"""
