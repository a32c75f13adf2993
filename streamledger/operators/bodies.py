"""JSON bodies: what clients write, and the frames that readers get."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(bodies: DataFrame) -> DataFrame:
    """``bodies`` (request, body) as records: (request, pos from 0, data, tag, node, meta, problem).

    A body is an object with records, each with data (any JSON, required, may be null), tag, node, meta; its own node is that of records without one.
    data and meta stay JSON text. A body that isn't JSON, has no records, or a record without data is one row with a problem and nothing else.
    """
    read = bodies.select("request", F.expr("try_parse_json(body)").alias("b"))
    read = read.select("request", F.expr("try_variant_get(b, '$.records', 'array<variant>')").alias("records"), F.expr("try_variant_get(b, '$.node', 'string')").alias("own"), F.col("b").isNull().alias("bad"))
    lacks = F.exists("records", lambda r: F.try_variant_get(r, "$.data", "variant").isNull())
    problem = F.when(F.col("bad"), "malformed JSON body").when(F.coalesce(F.size("records"), F.lit(0)) <= 0, "a write has at least one record").when(lacks, "a record has data")
    read = read.withColumn("problem", problem)
    rows = read.where("problem IS NULL").select("request", "own", F.posexplode("records").alias("pos", "r"))
    field = lambda name, kind: F.try_variant_get("r", f"$.{name}", kind)
    meta = field("meta", "variant")
    good = rows.select("request", F.col("pos").cast("long").alias("pos"), F.to_json(field("data", "variant")).alias("data"), field("tag", "string").alias("tag"), F.coalesce(field("node", "string"), "own").alias("node"), F.when(~F.is_variant_null(meta), F.to_json(meta)).alias("meta"), F.lit(None).cast("string").alias("problem"))
    none = F.lit(None).cast("string")
    bad = read.where("problem IS NOT NULL").select("request", none.cast("long").alias("pos"), none.alias("data"), none.alias("tag"), none.alias("node"), none.alias("meta"), "problem")
    return good.union(bad)


def _text(c: Column) -> Column:
    return F.to_json(c.cast("variant"))


def _json(c: str) -> Column:
    """What is JSON stays as it is; other text becomes a JSON string."""
    return F.when(F.expr(f"try_parse_json({c}) IS NOT NULL"), F.col(c)).otherwise(F.coalesce(_text(F.col(c)), F.lit("null")))


def frame(data: Column, tags: Column, meta: Column | None = None) -> Column:
    """A record as one JSON object. Fields of the server have a $; node, tag and meta are left out where absent, data only where ``data`` says so."""
    part = lambda key, value, when: F.when(when, F.concat(F.lit(f',"{key}":'), value)).otherwise("")
    out = [F.lit('{"$seq":'), F.col("seq").cast("string"), F.lit(',"$ts":'), F.col("ts_ms").cast("string")]
    out += [part("$node", _text(F.col("node")), F.col("node").isNotNull()), part("$tag", _text(F.col("tag")), tags & F.col("tag").isNotNull()), part("data", _json("data"), data)]
    if meta is not None:
        out.append(part("meta", F.col("meta"), meta & F.col("meta").isNotNull()))
    return F.concat(*out, F.lit("}"))


def shared_frames(logs: DataFrame, readers: DataFrame) -> DataFrame:
    """(reader, topic, seq, frame) of every reader (``readers``: reader, topic, from_seq, include_data, include_tags).

    A record is turned into text once for each form that some reader of its log asks for (four at most), however many readers share it.
    """
    forms = readers.groupBy("topic", "include_data", "include_tags").agg(F.min("from_seq").alias("after"))
    rows = logs.join(forms, "topic").where(F.col("seq") > F.col("after"))
    made = rows.select("topic", "seq", "include_data", "include_tags", frame(F.col("include_data"), F.col("include_tags")).alias("frame"))
    met = made.join(readers, ["topic", "include_data", "include_tags"]).where(F.col("seq") > F.col("from_seq"))
    return met.select("reader", "topic", "seq", "frame")
