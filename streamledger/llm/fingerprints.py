"""Document fingerprints: threshold-scaled sketches, in DataFrame operations only.

A sketch keeps every distinct five-word shingle hash below a fixed fraction of the hash space; a text of which no hash
is below it keeps its smallest. Sketches of parts merge into the sketch of the whole (``merge``), at any ratio
of sizes: the share of one sketch's hashes that another holds estimates containment, the share of the
union's both hold estimates Jaccard similarity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import materialize, partitions, text_bytes

WORDS = 5
SCALE = 4  # one hash in four
_SPLIT = r"[\x20\x09-\x0D]+"
RANGES = 1000  # of a level; there are two
_BOUND = (1 << 62) // SCALE  # hashes are shifted to 62 bits


def sketch(text: Column, words: int = WORDS) -> Column:
    """Sorted hashes (array of longs, 62 bits) of a text. Null and blank texts: empty. Fewer words: all of them as one shingle."""
    split = F.filter(F.split(F.coalesce(text, F.lit("")), _SPLIT), lambda w: w != "")
    hashed = F.transform(split, lambda w: F.xxhash64(w))
    # the array is bound once, by a one-element transform, so that it is not computed again for each shingle
    def shingles(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(h) - words, F.lit(0)))
        whole = F.transform(at, lambda i: F.shiftrightunsigned(F.xxhash64(*[h[i + j] for j in range(words)]), 2))
        short = F.array(F.shiftrightunsigned(F.xxhash64(F.concat_ws(",", h.cast("array<string>"))), 2))
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).when(F.size(h) < words, short).otherwise(whole)

    every = F.transform(F.array(hashed), shingles)[0]
    return _keep(every)


def _keep(every: Column) -> Column:
    def scaled(h: Column) -> Column:
        low = F.filter(h, lambda x: x < F.lit(_BOUND))
        return F.when(F.size(low) > 0, F.sort_array(F.array_distinct(low))).when(F.size(h) > 0, F.array(F.array_min(h))).otherwise(F.array().cast("array<bigint>"))

    return F.transform(F.array(every), scaled)[0]


def merge(a: Column, b: Column) -> Column:
    """The sketch of two texts' shingles together."""
    return _keep(F.array_union(a, b))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; null if a is empty."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity; two empty sketches are alike (1)."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1)))


def encode(a: Column) -> Column:
    """A sketch as text: the hashes in hexadecimal, joined by points."""
    return F.array_join(F.transform(a, lambda x: F.lower(F.hex(x))), ".")


def _place(edges: Column, id: Column, text: Column, level: int) -> Column:
    """A row's range between sorted edges. An id that several edges name holds whole ranges: its rows are dealt to these by a hash of the text."""
    below, upto = F.size(F.filter(edges, lambda x: x < id)), F.size(F.filter(edges, lambda x: x <= id))
    own = F.pmod(F.xxhash64(text, F.lit(level)), F.greatest(upto - below - 1, F.lit(1)).cast("long"))
    return F.when(upto - below < 2, below.cast("long")).otherwise(below + 1 + own).cast("long")


def _shares(n: int) -> list[float]:
    return [i / n for i in range(1, n)]


def _in_ranges(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` (id, text) with part: about ``n`` ranges in order of id, cut at RANGES percentiles and, where more are wanted, each of these again."""
    none = F.array().cast("array<bigint>")
    k = min(n, RANGES)
    found = rows.select(F.percentile_approx("id", _shares(k), 10000)).first()[0] if k > 1 else None
    edges = F.array(*[F.lit(x).cast("long") for x in found]) if found else none
    rows = rows.withColumn("part", _place(edges, F.col("id"), F.col("text"), 0))
    if n <= RANGES:
        return rows
    fine = min(RANGES, -(-n // RANGES))  # at most RANGES rows with as many edges, eight megabytes: a broadcast
    inner = rows.groupBy("part").agg(F.percentile_approx("id", _shares(fine), 10000).alias("edges"))
    rows = rows.join(F.broadcast(materialize(inner, "range-edges")), "part")
    return rows.withColumn("part", F.col("part") * (2 * RANGES) + _place(F.col("edges"), F.col("id"), F.col("text"), 1)).drop("edges")


def with_next(docs: DataFrame, target: int = 16 << 20) -> DataFrame:
    """(doc_id, text, sketch, next_text, next_sketch): each document and the next by ascending doc_id (after the last: the first).

    Documents are cut into ranges of doc_id of about ``target`` bytes, a million at most (beyond 16 TB they grow: 100 MB at 100 TB); a document
    at a range's end gets the first of the next range. Null ids come first. Rows that repeat a doc_id follow each other in order of text; where they
    fill ranges of their own (a third of all rows without id, say), they are dealt to these by a hash of the text and ordered there. One row is its
    own next; a null text is empty; other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")))
    rows = _in_ranges(rows, min(RANGES * RANGES, max(partitions(docs.sparkSession), text_bytes(docs) // target)))
    # the first document of each range: a row for each, so a broadcast
    firsts = materialize(rows.groupBy("part").agg(F.min("id").alias("id")), "range-starts")
    heads = rows.select("part", "id", "text").join(F.broadcast(firsts), ["part", "id"]).groupBy("part").agg(F.min("text").alias("head"))
    turn = Window.orderBy("part")  # a row for each range
    after = firsts.select("part").withColumn("after", F.coalesce(F.lead("part").over(turn), F.first("part").over(turn)))
    after = after.join(heads.withColumnRenamed("part", "after"), "after").select(F.col("part").alias("p"), "head")
    after = after.withColumn("head", F.struct(F.col("head").alias("text"), sketch(F.col("head")).alias("s")))
    dealt = rows.repartition("part").withColumn("s", sketch(F.col("text")))
    following = dealt.withColumn("x", F.lead(F.struct("text", "s")).over(Window.partitionBy("part").orderBy("id", "text")))
    met = following.join(after, (F.col("part") == F.col("p")) & F.col("x").isNull(), "left").withColumn("x", F.coalesce("x", "head"))
    return met.select("doc_id", "text", F.col("s").alias("sketch"), F.col("x.text").alias("next_text"), F.col("x.s").alias("next_sketch"))


def op7_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how alike they are."""
    docs = with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    docs = docs.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    docs = docs.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.col("sketch").alias("s"), sketch(F.col("edited")).alias("e"), F.col("next_sketch").alias("x"))
    return docs.select("doc_id", "n_chars", "edited_sha256", encode(F.col("s")).alias("fingerprint"), encode(F.col("e")).alias("edited_fingerprint"), likeness(F.col("s"), F.col("e")).alias("near_edited"), likeness(F.col("s"), F.col("x")).alias("near_next"))
