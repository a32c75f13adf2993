"""Corpus-wide key statistics without a row per occurrence.

Documents are dealt into chunks. A chunk sends its *distinct* keys (64-bit hashes, sorted) once, with what
it already knows of each (a count, its smallest document): a key that fills a third of the corpus costs
one entry a chunk. Keys are cut into buckets by value; a bucket combines what all chunks sent and answers
each chunk in the chunk's own key order. The chunk's documents then meet the answers in a cogroup.

Rows that travel are packed arrays (differences of sorted keys by byte plane, zstd), about five bytes a key.
A chunk's message depends on the set of its documents only, never on their order, so a task that is run again
after a lost executor sends the same bytes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import partitions, release, small_batches, text_bytes

CHUNK, BUCKET = 32 << 20, 64 << 20  # bytes of text that a chunk holds, and that a bucket's keys come from
_SENT = "b int, c int, n int, body binary"


def pack(*columns: np.ndarray) -> bytes:
    """Integer columns as zstd-compressed byte planes; the first is sent as differences."""
    z = zstandard.ZstdCompressor(level=1)
    out = []
    for k, x in enumerate(columns):
        x = np.ascontiguousarray(x, np.uint64 if x.dtype == np.uint64 else np.int64).view(np.uint64)
        if k == 0 and len(x):
            x = np.diff(x, prepend=np.uint64(0))
        planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T)
        body = z.compress(planes.tobytes())
        out += [np.array([len(x), len(body)], np.int64).tobytes(), body]
    return b"".join(out)


def unpack(body: bytes) -> list[np.ndarray]:
    out, at = [], 0
    z = zstandard.ZstdDecompressor()
    while at < len(body):
        n, size = (int(v) for v in np.frombuffer(body, np.int64, 2, at))
        at += 16
        planes = np.frombuffer(z.decompress(body[at : at + size], max_output_size=max(8 * n, 1)), np.uint8)
        x = np.ascontiguousarray(planes.reshape(8, n).T).view(np.uint64).reshape(n)
        out.append(np.cumsum(x, dtype=np.uint64) if not out else x)
        at += size
    return out


def bounds(buckets: int) -> np.ndarray:
    """Smallest key of each bucket: equal ranges of the 64-bit space."""
    return np.array([(i << 64) // buckets for i in range(buckets)], np.uint64)


def with_chunk(docs: DataFrame, chunks: int, *key: str) -> DataFrame:
    return docs.withColumn("_chunk", F.pmod(F.xxhash64(*key), F.lit(chunks)).cast("int"))


def _messages(chunk: int, keys: np.ndarray, values: list[np.ndarray], buckets: int) -> pa.Table:
    cut = np.append(np.searchsorted(keys, bounds(buckets)), len(keys))
    rows = [(i, chunk, int(cut[i + 1] - cut[i]), pack(keys[cut[i] : cut[i + 1]], *(v[cut[i] : cut[i + 1]] for v in values))) for i in range(buckets) if cut[i + 1] > cut[i]]
    b, c, n, body = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.table({"b": pa.array(b, pa.int32()), "c": pa.array(c, pa.int32()), "n": pa.array(n, pa.int32()), "body": pa.array(body, pa.binary())})


def in_batches(table: pa.Table, rows: int = 1024, size: int = 4 << 20) -> pa.Table:
    """``table`` in batches of at most ``rows`` rows and about ``size`` bytes: the executor receives one at a time, not a chunk's whole result."""
    rows = max(1, min(rows, int(rows if not table.nbytes else size * table.num_rows // table.nbytes)))
    return pa.Table.from_batches(table.combine_chunks().to_batches(rows), table.schema) if table.num_rows else table


def _answers(sent: pa.Table) -> list[np.ndarray]:
    """A chunk's answers of all buckets, in the order of its keys."""
    rows = sorted(zip(sent["b"].to_pylist(), sent["body"].to_pylist(), strict=True))
    parts = [unpack(x)[1:] for _, x in rows]
    return [np.concatenate([p[j] for p in parts]).view(np.int64) for j in range(len(parts[0]))] if parts else []


def distinct(values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct values, position of each one's first, its place among them for each value) of the arrays in a row; empties the list.

    ``np.unique`` holds twice as much meanwhile.
    """
    whole = np.concatenate([np.zeros(0, np.uint64), *values])
    values.clear()
    small = np.int32 if len(whole) < 2**31 else np.int64
    order = np.argsort(whole).astype(small)
    whole = whole[order]
    new = np.ones(len(whole), bool)
    np.not_equal(whole[1:], whole[:-1], out=new[1:])
    keys = whole[new]
    del whole
    at = np.minimum.reduceat(order, np.flatnonzero(new)) if len(keys) else order
    inverse = np.empty(len(order), small)
    inverse[order] = np.cumsum(new, dtype=small) - small(1)
    return keys, at, inverse


def exchange(
    docs: DataFrame,
    columns: list[str],
    key: list[str],
    local: Callable[[pa.Table], tuple[np.ndarray, list[np.ndarray]]],
    combine: Callable[[np.ndarray, np.ndarray, list[np.ndarray]], list[np.ndarray]],
    finish: Callable[[pa.Table, list[np.ndarray]], pa.Table],
    schema: str,
) -> DataFrame:
    """Run ``local`` on each chunk, ``combine`` on each bucket, ``finish`` on each chunk with the answers.

    ``local(table)`` gives the chunk's sorted distinct keys and their value columns. ``combine(starts, order,
    values)`` gets the bucket's values in the order they came, the permutation that sorts their keys and where
    each distinct key starts in it; it returns answer columns in the order the values came.
    ``finish(table, answers)`` gets the answers aligned with the chunk's keys and returns the result rows.
    """
    spark = small_batches(docs).sparkSession
    size = text_bytes(docs)
    chunks, buckets = max(2 * partitions(spark), -(-size // CHUNK)), max(partitions(spark), -(-size // BUCKET))
    dealt = with_chunk(docs.select(*columns), chunks, *key)
    names = list(columns)

    def send(k, table):
        keys, values = local(table.select(names))
        out = _messages(k[0].as_py(), keys, values, buckets)
        del keys, values
        release()
        return in_batches(out)

    def reduce(k, table):
        parts = [unpack(x) for x in table["body"].to_pylist()]
        chunk_ids, sizes = table["c"].to_pylist(), [len(p[0]) for p in parts]
        keys = np.concatenate([p[0] for p in parts])
        values = [np.concatenate([p[j] for p in parts]).view(np.int64) for j in range(1, len(parts[0]))]
        del parts
        order = np.argsort(keys)
        ordered = keys[order]
        starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        del keys, ordered
        answers = combine(starts, order, values)
        del values, order, starts
        cut = np.concatenate([[0], np.cumsum(sizes)])
        body = [pack(np.zeros(0, np.uint64), *(x[cut[i] : cut[i + 1]] for x in answers)) for i in range(len(sizes))]
        b = k[0].as_py()
        del answers
        release()
        return in_batches(pa.table({"b": pa.array([b] * len(sizes), pa.int32()), "c": pa.array(chunk_ids, pa.int32()), "n": pa.array(sizes, pa.int32()), "body": pa.array(body, pa.binary())}))

    def meet(table, sent):
        if not table.num_rows:
            return _empty
        out = in_batches(finish(table.select(names), _answers(sent)))
        release()
        return out

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    _empty = to_arrow_schema(StructType.fromDDL(schema)).empty_table()
    sent = dealt.groupBy("_chunk").applyInArrow(send, _SENT)
    back = sent.groupBy("b").applyInArrow(reduce, _SENT)
    return dealt.groupBy("_chunk").cogroup(back.groupBy("c")).applyInArrow(meet, schema)


def expand(per_key: np.ndarray, starts: np.ndarray, order: np.ndarray) -> np.ndarray:
    """A value of each distinct key, back in the order in which the entries came."""
    out = np.empty(len(order), per_key.dtype)
    out[order] = np.repeat(per_key, np.diff(np.append(starts, len(order))))
    return out
