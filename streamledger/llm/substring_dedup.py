"""Substring dedup: windows of words that already start in an earlier document are cut out.

Rabin-Karp hashes of every ``window`` consecutive words are counted across the corpus (``exchange``: each
chunk sends its distinct windows once with the smallest document that has them, a bucket takes the minimum).
A window is repeated if a document with a smaller id has it; repeated windows of a document merge into maximal
intervals of words, which are removed. Windows are judged on the input, not on what is left.

Defined results: a null text is empty; a document of fewer than ``window`` words keeps all; rows that share a
doc_id count as one document for the rule (they never cut each other); a null doc_id counts as larger than
all others; a very long text is read whole, its windows are a few arrays; repeated rows are cut alike; other columns of the input are
ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exchange import distinct, exchange, expand
from .words import documents_words, roll, text_buffer, window_index

SCHEMA = "doc_id long, n_words long, n_removed long, spans array<struct<start: long, stop: long>>, kept_text string"
_LAST = np.iinfo(np.int64).max


def _ids(table: pa.Table) -> np.ndarray:
    return pc.fill_null(table["doc_id"], _LAST).to_numpy()


def _windows(table: pa.Table, k: int):
    """The chunk's windows, documents in ascending id: (sorted table, ids, keys, first window of each key, key of each window, windows' documents)."""
    table = table.sort_by("doc_id")
    ids = _ids(table)
    order = np.argsort(ids, kind="stable")
    if (order[1:] < order[:-1]).any():
        table, ids = table.take(pa.array(order)), ids[order]
    table = table.combine_chunks()
    data, offsets = text_buffer(table["text"])
    hashes, docs = [], [np.zeros(0, np.int32)]
    for a, b, first, h, *_ in documents_words(data, offsets):
        index, window_offsets = window_index(first, k)
        hashes.append(roll(h, k)[index])
        docs.append(np.repeat(np.arange(a, b, dtype=np.int32), np.diff(window_offsets)))
    owner = np.concatenate(docs)
    del docs
    return table, ids, *distinct(hashes), owner


def remove_repeated_windows(docs: DataFrame, window: int = 13, row: Column | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, spans of removed words, kept_text: the kept words joined by one space).

    With ``row`` (a struct of other columns) the text as it was and the row come along, as text and row, so that
    nobody has to join the texts again.
    """
    extra = [] if row is None else ["row"]
    schema = SCHEMA if row is None else f"{SCHEMA}, text string, row {docs.select(row.alias('row')).dtypes[0][1]}"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *([] if row is None else [row.alias("row")]))

    def local(table: pa.Table):
        _, ids, keys, at, _, owner = _windows(table, window)
        return keys, [ids[owner[at]]]

    def combine(starts, order, values):
        least = np.minimum.reduceat(values[0][order], starts)
        return [(expand(least, starts, order) < values[0]).astype(np.int64)]

    def finish(table: pa.Table, answers):
        table, ids, keys, at, inverse, owner = _windows(table, window)
        if len(keys):
            rank = np.cumsum(np.diff(ids, prepend=ids[:1]) != 0, dtype=np.int32)  # ids ascend
            repeated = answers.pop().astype(bool)[inverse]
            repeated |= rank[owner] > rank[owner[at]][inverse]
        else:
            repeated = np.zeros(0, bool)
        del keys, at, inverse, owner
        data, offsets = text_buffer(table["text"])
        n, at_window = len(ids), 0
        n_words, n_removed = np.zeros(n, np.int64), np.zeros(n, np.int64)
        span_rows, span_of, pieces, lengths = [], [], [], np.zeros(n, np.int64)
        for a, b, first, _, part, starts, ends in documents_words(data, offsets):
            index, window_offsets = window_index(first, window)
            flags = repeated[at_window : at_window + len(index)]
            at_window += len(index)
            change = np.zeros(len(starts) + 1, np.int64)
            np.add.at(change, index[flags], 1)
            np.add.at(change, index[flags] + window, -1)
            cut = np.cumsum(change[:-1]) > 0
            removed = np.concatenate([[0], np.cumsum(cut)])
            n_words[a:b], n_removed[a:b] = np.diff(first), removed[first[1:]] - removed[first[:-1]]
            edge = np.zeros(len(starts) + 1, bool)
            edge[first] = True
            begin = np.flatnonzero(cut & (np.concatenate([[True], ~cut[:-1]]) | edge[:-1])) if len(cut) else np.zeros(0, np.int64)
            stop = np.flatnonzero(cut & (np.concatenate([~cut[1:], [True]]) | edge[1:])) + 1 if len(cut) else begin
            of = np.searchsorted(first, begin, "right") - 1
            span_rows.append(np.stack([begin - first[of], stop - first[of]], 1))
            span_of.append(of + a)
            kept = ~cut
            cover = np.zeros(len(part) + 1, np.int8)
            cover[starts[kept]] += 1
            cover[ends[kept]] -= 1  # a word may start where the one before ends, at a document's edge
            both = np.intersect1d(starts[kept], ends[kept], assume_unique=True)
            cover[both] = 0
            mask = np.cumsum(cover[:-1], dtype=np.int8) > 0
            where = np.flatnonzero(kept)
            doc_of = np.searchsorted(first, where, "right") - 1
            gap = ends[where[:-1][doc_of[:-1] == doc_of[1:]]]
            part = part.copy()
            part[gap] = 0x20
            mask[gap] = True
            size = np.concatenate([[0], np.cumsum(mask)])
            lengths[a:b] = np.diff(size[offsets[a : b + 1] - offsets[a]])
            pieces.append(part[mask])
        spans, of = np.concatenate([np.zeros((0, 2), np.int64), *span_rows]), np.concatenate([np.zeros(0, np.int64), *span_of])
        struct = pa.StructArray.from_arrays([pa.array(spans[:, 0]), pa.array(spans[:, 1])], ["start", "stop"])
        span_offsets = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))]).astype(np.int32)
        text_offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        body = np.concatenate([np.zeros(0, np.uint8), *pieces])
        del pieces
        text = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(text_offsets), pa.py_buffer(body)])
        columns = [table["doc_id"].combine_chunks(), pa.array(n_words), pa.array(n_removed), pa.ListArray.from_arrays(pa.array(span_offsets), struct), text]
        columns[-1] = text.cast(pa.string())  # raises where a chunk's kept text passes 2 GiB; chunks are cut to about 32 MB
        out = pa.table(dict(zip(["doc_id", "n_words", "n_removed", "spans", "kept_text"], columns, strict=True)))
        for c in ["text", *extra] if extra else []:
            out = out.append_column(c, table[c])
        return out

    return exchange(docs, ["doc_id", "text", *extra], ["doc_id", "text"], local, combine, finish, schema)


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of what ``remove_repeated_windows`` keeps, over all documents."""
    out = remove_repeated_windows(spark.read.parquet(f"{sf_dir}/documents.parquet"), 13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13),
g AS (SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS k FROM p),
f AS (SELECT k, min(doc_id) AS lo FROM g GROUP BY k),
r AS (SELECT g.doc_id, g.i FROM g JOIN f ON g.k = f.k WHERE f.lo < g.doc_id),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM r),
a AS (SELECT doc_id, list(j) AS js, count(*) AS n FROM c GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(a.n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN a.n IS NULL THEN ws ELSE
    list_transform(list_filter(range(1, len(ws) + 1), lambda x: NOT list_contains(a.js, x)), lambda x: ws[x]) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN a ON w.doc_id = a.doc_id
"""
