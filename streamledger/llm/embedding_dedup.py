"""Embedding near-dedup: an exact metric range join on cosine similarity within a label.

Unit vectors at cosine s are sqrt(2 - 2 s) apart, a metric. Per label, pivots (the vectors with the smallest hashes) cut space
into cells: a vector's home is its nearest pivot. A pair within radius r of each other whose homes differ has the one
vector within 2 r of the tie between the two pivots (triangle inequality), and within r of the plane halfway between them;
only such vectors are copied into the other cell, towards the smaller number. Cells are joined independently, in blocks
of bounded size, by matrix products in double precision.

Equal vectors collapse first and count with their number. A block returns degrees and a forest of its links, never all
pairs, so a cluster of n vectors costs n rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .runtime import materialize, spread

CELL = 1024  # vectors a pivot stands for
MAX_PIVOTS = 1024  # pivots of a label
BLOCK = 4096  # vectors a task holds from either side
_EPS = 1e-9


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _binary(batches):
    """The vectors as packed doubles."""
    for t in batches:
        vectors = t.column("v")
        flat = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64)
        offsets = np.concatenate([[0], np.cumsum(vectors.value_lengths().to_numpy(zero_copy_only=False))]).astype(int)
        body = [flat[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([t.column("rep"), t.column("space"), t.column("c"), pa.array(body, pa.binary())], ["rep", "space", "c", "v"])


def _assign(radius: float):
    """Home cell of each vector, and the lower cells into which the boundary copies it."""

    def run(rows, pivots):
        out: dict[str, list] = {"space": [], "cell": [], "home": [], "rep": [], "c": [], "v": []}
        if rows.num_rows:
            raw = rows["v"].to_pylist()
            p = _unit(pivots.sort_by("pivot")["pv"].to_pylist() or raw[:1])  # without a pivot any vector serves: all get cell 0
            x = _unit(raw)
            d = np.sqrt(np.maximum(2 - 2 * (x @ p.T), 0))
            between = np.sqrt(np.maximum(2 - 2 * (p @ p.T), 0))
            home = d.argmin(1)
            nearest = d[np.arange(len(x)), home]
            gap = between[home]
            near = d <= nearest[:, None] + 2 * radius + _EPS
            near &= d**2 - (nearest**2)[:, None] <= 2 * gap * radius + _EPS
            near &= np.arange(len(p))[None, :] < home[:, None]
            near[np.arange(len(x)), home] = True
            i, cell = np.nonzero(near)
            space, reps, counts = rows["space"][0].as_py(), rows["rep"].to_pylist(), rows["c"].to_pylist()
            out = {"space": [space] * len(i), "cell": cell.tolist(), "home": (home[i] == cell).tolist(), "rep": [reps[k] for k in i], "c": [counts[k] for k in i], "v": [raw[k] for k in i]}
        kinds = {"space": pa.string(), "cell": pa.int32(), "home": pa.bool_(), "rep": pa.int64(), "c": pa.int64(), "v": pa.binary()}
        return pa.table({k: pa.array(out[k], t) for k, t in kinds.items()})

    return run


def _join(threshold: float):
    """Degrees and a forest of the links between a block of a cell's own vectors and a block of all it holds."""

    def run(own, other):
        ids, degree, low = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if own.num_rows and other.num_rows:
            ra, ca = own["rep"].to_numpy(), own["c"].to_numpy()
            rb, cb = other["rep_b"].to_numpy(), other["c_b"].to_numpy()
            own_b = other["home_b"].to_numpy(zero_copy_only=False)
            raw_a, raw_b = own["v"].to_pylist(), other["v_b"].to_pylist()
            a, b = _unit(raw_a), _unit(raw_b)
            s = a @ b.T
            mask = s >= threshold
            for i, j in zip(*np.nonzero(np.abs(s - threshold) < 1e-13), strict=True):
                mask[i, j] = _cosine(raw_a[i], raw_b[j]) >= threshold
            mask &= ~own_b[None, :] | (ra[:, None] < rb[None, :])  # a pair of the cell's own once
            rows, columns = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
            mask = mask[np.ix_(rows, columns)]
            ra, ca, rb, cb = ra[rows], ca[rows], rb[columns], cb[columns]
            la, lb = ra.copy(), rb.copy()
            while len(rows):
                label = dict(zip(ra.tolist(), la.tolist(), strict=True))
                for r, v in zip(rb.tolist(), lb.tolist(), strict=True):
                    label[r] = min(v, label.get(r, v))
                la, lb = np.array([label[r] for r in ra.tolist()]), np.array([label[r] for r in rb.tolist()])
                na = np.minimum(la, np.where(mask, lb[None, :], np.iinfo(np.int64).max).min(1))
                nb = np.minimum(lb, np.where(mask, na[:, None], np.iinfo(np.int64).max).min(0))
                same = (na == la).all() and (nb == lb).all()
                la, lb = na, nb
                if same:
                    break
            ids = np.concatenate([ra, rb])
            degree = np.concatenate([mask @ cb, ca @ mask]).astype(np.int64)
            low = np.concatenate([la, lb])
        return pa.table({"rep": pa.array(ids), "degree": pa.array(degree), "low": pa.array(low)})

    return run


def _cosine(a: bytes, b: bytes) -> float:
    x, y = (v / np.abs(v).max() for v in (np.frombuffer(a, np.float64), np.frombuffer(b, np.float64)))
    dot = lambda u, v: math.fsum((u * v).tolist())
    return dot(x, y) / math.sqrt(dot(x, x)) / math.sqrt(dot(y, y))


def near_duplicates(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding, label).

    Rows without label or vec_id, and null, empty or zero vectors and those with a null, NaN or infinite component link with nothing;
    so do vectors of different lengths. Rows that repeat a vec_id count as vectors of their own in n_links and share
    their component. Without vec_id the component is null and kept false. A cosine at the threshold itself is computed anew, exactly rounded.
    Very long vectors are compared whole. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    space = F.concat_ws(":", F.size("v").cast("string"), "label")
    good = rows.where(usable).select("vec_id", space.alias("space"), F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))
    good = good.withColumn("key", F.sha2(F.col("v").cast("string"), 256))
    classes = good.groupBy("space", "key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("c"), F.min_by("v", "vec_id").alias("v"))
    classes = materialize(classes, "classes")
    member = good.select("vec_id", "space", "key").join(classes.select("space", "key", "rep", "c"), ["space", "key"])
    packed = classes.select("rep", "space", "c", "v").mapInArrow(_binary, "rep long, space string, c long, v binary")

    # pivots: of each space the classes with the smallest hashes, as many as it has cells
    spaces = classes.groupBy("space").agg(F.count("*").alias("n")).withColumn("pivots", F.least(F.ceil(F.col("n") / CELL), F.lit(MAX_PIVOTS)).cast("int")).withColumn("salts", F.ceil(F.col("n") / BLOCK).cast("int"))
    spaces = materialize(spaces, "spaces")
    mark = F.shiftrightunsigned(F.xxhash64("rep"), 34)  # thirty bits
    likely = packed.join(spaces, "space").where(mark <= F.least(F.lit(1.0), 4.0 * (F.col("pivots") + 8) / F.col("n")) * (1 << 30))
    rank = F.row_number().over(Window.partitionBy("space").orderBy(mark, "rep"))
    pivots = likely.withColumn("pivot", rank).where("pivot <= pivots")
    pivots = pivots.select(F.col("space").alias("pivot_space"), "pivot", F.col("v").alias("pv"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("pivot_salt"))
    salted = packed.join(spaces.select("space", "salts"), "space").withColumn("salt", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("salts")).cast("int"))
    radius = math.sqrt(2 - 2 * threshold)
    # dealt by all keys, not by space as the joins above are: a label may hold a third of all vectors
    salted, pivots = salted.repartition("space", "salt"), pivots.repartition("pivot_space", "pivot_salt")
    cells = salted.groupBy("space", "salt").cogroup(pivots.groupBy("pivot_space", "pivot_salt")).applyInArrow(_assign(radius), "space string, cell int, home boolean, rep long, c long, v binary")
    cells = materialize(cells, "cells")

    blocks = cells.groupBy("space", "cell").agg(F.ceil(F.sum(F.col("home").cast("long")) / BLOCK).cast("int").alias("hb"), F.ceil(F.count("*") / BLOCK).cast("int").alias("rb")).where("hb > 0")
    blocks = spread(blocks)
    both = cells.join(blocks, ["space", "cell"])
    turn = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = both.where("home").select("space", "cell", "rep", "c", "v", F.pmod(F.xxhash64("rep", F.lit(2)), F.col("hb")).cast("int").alias("i"), turn("rb").alias("j"))
    other = both.select(F.col("space").alias("space_b"), F.col("cell").alias("cell_b"), F.col("rep").alias("rep_b"), F.col("c").alias("c_b"), F.col("v").alias("v_b"), F.col("home").alias("home_b"), F.pmod(F.xxhash64("rep", F.lit(3)), F.col("rb")).cast("int").alias("j_b"), turn("hb").alias("i_b"))
    own, other = own.repartition("space", "cell", "i", "j"), other.repartition("space_b", "cell_b", "i_b", "j_b")
    links = own.groupBy("space", "cell", "i", "j").cogroup(other.groupBy("space_b", "cell_b", "i_b", "j_b")).applyInArrow(_join(threshold), "rep long, degree long, low long")
    links = materialize(links, "links")
    degrees = links.groupBy("rep").agg(F.sum("degree").alias("degree"))
    whole = components(links.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    facts = degrees.join(whole, degrees.rep == whole.id, "left").select("rep", "degree", "component")
    member = member.join(facts, "rep", "left").select("vec_id", (F.coalesce("degree", F.lit(0)) + F.col("c") - 1).alias("n"), F.coalesce("component", "rep").alias("component"))
    # a repeated vec_id is a row each time, and one node
    shared = member.groupBy("vec_id").agg(F.min("component").alias("component"), F.max("n").alias("n"))
    out = rows.select("vec_id").join(shared, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op10_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """All vectors against all of the same label, cosine 0.93 or more."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.93)


OP10_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE label IS NOT NULL AND e IS NOT NULL
  AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
d AS (SELECT x, count(*) AS n FROM l GROUP BY x),
r AS (SELECT x AS id, x AS node FROM l UNION SELECT r.id, l.y FROM r JOIN l ON r.node = l.x),
c AS (SELECT id, min(node) AS low FROM r GROUP BY id)
SELECT v.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, coalesce(c.low, v.vec_id) AS component_id, coalesce(c.low, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN d ON v.vec_id = d.x LEFT JOIN c ON v.vec_id = c.id
"""
