"""Best-fit packing with certified repacking.

Texts become token ids with an end id; a text over the sequence length is cut into full pieces behind a first, shorter
one, so only its remainder is left to place. Pieces are dealt into partitions of bounded size and each partition is
packed by best-fit decreasing. A dual-feasible function turns lengths into a lower bound on a partition's bins; where
the packing meets the bound, it is certified and done. Partitions with a gap keep their full bins and put the pieces of
the others into a pool, which is dealt anew (so partitions exchange documents) into fewer partitions and packed again,
until all are certified, a round saves no bin, or the rounds end. Every round keeps the better of old and new.
"""

from __future__ import annotations

import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import materialize, partitions, release, small_batches
from .tokens import tokenizer

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PARTITION, LEAST = 40_000, 2_000  # pieces that one task packs: at most, and at least while there are enough
SLICE = 1 << 18  # characters that a worker cuts and encodes at a time; a longer text by itself


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that pieces need at least; ``counts[n]`` pieces have length n.

    The largest over the dual-feasible functions u_e: lengths over capacity - e count as a whole bin, lengths
    under e as nothing, the others as they are (e = 1 is the sum of lengths).
    """
    n = np.arange(capacity + 1)
    total = np.cumsum(counts * n)
    number = np.cumsum(counts)
    best = -(-int(total[-1]) // capacity)
    for e in range(2, capacity // 2 + 1):
        big = int(number[-1] - number[capacity - e])
        middle = int(total[capacity - e] - total[e - 1])
        best = max(best, big + -(-middle // capacity))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each piece, its offset there, room left in each bin). Ties go to the piece that comes first and the bin opened last."""
    order = np.argsort(-lengths, kind="stable")
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r: some bin has room r
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    left: list[int] = []
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fit = mask >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, len(left)
            left.append(capacity)
        bins[i], offsets[i] = b, capacity - room
        room -= n
        left[b] = room
        if room:
            rooms[room].append(b)
            mask |= 1 << room
    return bins, offsets, np.array(left, np.int64)


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32); the cut puts the shorter piece first."""
    name = str(Path(path))

    def run(batches):
        t = tokenizer(name)
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            doc_ids = batch.column("doc_id")
            rows: list[tuple] = []
            a = 0
            while a < len(texts):
                b, size = a, 0
                while b < len(texts) and (b == a or size + len(texts[b]) <= SLICE):
                    size += len(texts[b])
                    b += 1
                ids, offsets = t.batch(texts[a:b])
                for i in range(a, b):
                    own = np.append(ids[offsets[i - a] : offsets[i - a + 1]], end_id).astype("<u4")
                    n = len(own)
                    cut = [0, *range(n % capacity or capacity, n, capacity), n] if n > capacity else [0, n]
                    rows += [(i, k, cut[k], cut[k + 1] - cut[k], zlib.crc32(own[cut[k] : cut[k + 1]].tobytes())) for k in range(len(cut) - 1)]
                a = b
            i, k, start, length, crc = zip(*rows, strict=True) if rows else ((), (), (), (), ())
            at = pa.array(i, pa.int64())
            yield pa.RecordBatch.from_arrays([doc_ids.take(at), pa.array(k, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])
        release()

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _PIECES)


def _pack(capacity: int):
    """Pack one part; bins of a certified part, and full bins, are settled, the rest may go back to the pool."""

    def run(key, table):
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("uid", "ascending")])
        lengths = table["length"].to_numpy()
        bins, offsets, left = best_fit_decreasing(lengths, capacity)
        certified = len(left) <= lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        settled = np.full(len(lengths), True) if certified else left[bins] == 0
        rows = {c: table[c] for c in _COLUMNS} | {"bin": pa.array(bins + key[0].as_py() * (1 << 28)), "offset": pa.array(offsets), "settled": pa.array(settled)}
        return pa.table(rows)

    return run


_COLUMNS = ["uid", "doc_id", "piece", "start", "length", "ids_crc32"]
_PACKED = f"uid long, {_PIECES}, bin long, offset long, settled boolean"


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, rounds: int = 5, part: int = PARTITION) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece.

    A null or empty text is one piece of the end id alone. Rows that repeat a doc_id are packed one by one.
    A null doc_id stays null. An empty table gives no rows. Other columns are ignored. Full pieces need no packing and take a sequence each.
    """
    pieces = materialize(token_pieces(docs, path, capacity, end_id).select(F.monotonically_increasing_id().alias("uid"), "*"), "pieces")
    full = pieces.where(f"length = {capacity}")
    pool = pieces.where(f"length < {capacity}")
    settled: list[DataFrame] = []
    waiting, waiting_bins = None, 0  # the best packing so far of what is in the pool
    total = pool.count()
    for r in range(rounds):
        if not total:
            break
        # dealt by hash, so a part has the lengths of the whole; each round brings together pieces that were apart
        parts = max(min(partitions(docs.sparkSession), total // LEAST) if r == 0 else 1, -(-total // part))
        number = F.pmod(F.xxhash64("uid", F.lit(r)), F.lit(parts)) + F.lit(r << 28)
        packed = materialize(pool.withColumn("part", number.cast("long")).groupBy("part").applyInArrow(_pack(capacity), _PACKED), "packed")
        bins = packed.agg(F.count_distinct("bin")).first()[0]
        if waiting is not None and bins >= waiting_bins:
            break
        settled.append(packed.where("settled"))
        waiting = packed.where("NOT settled")
        total, waiting_bins = waiting.agg(F.count("*"), F.count_distinct("bin")).first()
        pool = waiting.select(*_COLUMNS)
        if not total:
            waiting = None
            break
    out = full.select(*_COLUMNS[1:], (F.col("uid") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    for d in settled + ([waiting] if waiting is not None else []):
        out = out.union(d.select(*_COLUMNS[1:], (F.col("bin") * 2).alias("sequence_id"), "offset"))
    return out


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), 1024, 2)
