"""Language-model scoring by cross-entropy difference of a target and a background bigram model.

Both models are counted over one shared vocabulary, the words of both corpora together, with the same smoothing:

    q(w)     = c(w) / T                                    both corpora pooled
    p_m(w)   = (c_m(w) + A q(w)) / (T_m + A)               m: target or background
    p_m(w|v) = (c_m(v,w) + B p_m(w)) / (c_m(v) + B)        the first word of a text: p_m(w)

score = mean over the text's words of log2 p_background - log2 p_target, in bits a word: the lower, the more
like the target. The background is the scored corpus itself, each document held out of its own counts. All words and
word pairs of both corpora are counted, by ``exchange``: each chunk sends its distinct ones once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import exchange, expand
from .words import documents_words, roll, text_buffer

PRIOR_WORD, PRIOR_PAIR = 1000.0, 10.0
_TOTAL = np.uint64(0)  # the key under which chunks send their numbers of words


def _counted(table: pa.Table):
    """Words and word pairs of each document: (word hash, pair hash or none at a first word, document) in text order."""
    data, offsets = text_buffer(table["text"])
    words, pairs, owner, start = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    for a, b, first, h, *_ in documents_words(data, offsets, lower=True):
        head = np.zeros(len(h), bool)
        head[first[:-1][np.diff(first) > 0]] = True
        pair = np.zeros(len(h), np.uint64)
        if len(h) > 1:
            pair[1:] = roll(h, 2)
        words.append(h)
        pairs.append(pair)
        owner.append(np.repeat(np.arange(a, b), np.diff(first)))
        start.append(head)
    return np.concatenate(words), np.concatenate(pairs), np.concatenate(owner), np.concatenate(start)


def cross_entropy_difference(docs: DataFrame, target: DataFrame, prior_word: float = PRIOR_WORD, prior_pair: float = PRIOR_PAIR) -> DataFrame:
    """(doc_id, n_words, target_bits, background_bits: cross-entropies a word, score: their difference).

    ``docs`` has doc_id and text, ``target`` text. Words are runs of ``[^\\x20\\x09-\\x0D]`` with A-Z lower-cased.
    A null or blank text has no words and null figures. Rows that repeat a doc_id are texts of their own.
    An empty target leaves its model at the prior; an empty corpus gives no rows. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(0).alias("target"))
    target = target.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(1).alias("target"))

    def keys_of(words, pairs, start):
        return np.concatenate([[_TOTAL], words, pairs[~start]]).astype(np.uint64)

    def local(table: pa.Table):
        words, pairs, owner, start = _counted(table)
        wanted = table["target"].to_numpy()[owner] == 1
        every = keys_of(words, pairs, start)
        hit = np.concatenate([[False], wanted, wanted[~start]])
        keys, inverse = np.unique(every, return_inverse=True)
        total = np.bincount(inverse, minlength=len(keys)).astype(np.int64)
        aimed = np.bincount(inverse[hit], minlength=len(keys)).astype(np.int64)
        total[0], aimed[0] = len(words), int(wanted.sum())
        return keys, [total, aimed]

    def combine(starts, order, values):
        return [expand(np.add.reduceat(v[order], starts), starts, order) for v in values]

    def finish(table: pa.Table, answers):
        words, pairs, owner, start = _counted(table)
        keys, inverse = np.unique(keys_of(words, pairs, start), return_inverse=True)
        both, aimed = (a.astype(np.float64) for a in answers)
        n = len(words)
        word = inverse[1 : n + 1]
        pair = np.zeros(n, np.int64)
        pair[~start] = inverse[n + 1 :]
        before = np.zeros(n, np.int64)
        before[1:] = word[:-1]
        size = np.bincount(owner, minlength=table.num_rows).astype(np.float64)

        def own(index, valid):
            """How often the document itself has each key."""
            mark = owner[valid] * np.int64(len(keys)) + index[valid]
            _, back, count = np.unique(mark, return_inverse=True, return_counts=True)
            out = np.zeros(n)
            out[valid] = count[back]
            return out

        everywhere = np.ones(n, bool)
        mine = own(word, everywhere)
        mine_before = np.zeros(n)
        mine_before[1:] = mine[:-1]
        q = both[word] / both[0] if n else np.zeros(0)
        bits = []
        scored = (table["target"].to_numpy() == 0)[owner].astype(np.float64)
        for c, held in ((aimed, 0.0), (both - aimed, scored)):
            p = (c[word] - held * mine + prior_word * q) / (c[0] - held * size[owner] + prior_word)
            joint = c[pair] - held * own(pair, ~start)
            chained = (joint + prior_pair * p) / (c[before] - held * mine_before + prior_pair)
            bits.append(-np.log2(np.where(start, p, chained)))
        edge = np.flatnonzero(start)
        rows = np.flatnonzero(size > 0)
        mean = [np.full(table.num_rows, np.nan) for _ in bits]
        for m, x in zip(mean, bits, strict=True):
            if n:
                m[rows] = np.add.reduceat(x, edge) / size[rows]
        none = size == 0
        out = pa.table({"doc_id": table["doc_id"].combine_chunks(), "n_words": pa.array(size.astype(np.int64)), "target_bits": pa.array(mean[0], mask=none), "background_bits": pa.array(mean[1], mask=none), "score": pa.array(mean[0] - mean[1], mask=none)})
        return out.filter(pa.array(table["target"].to_numpy() == 0))

    return exchange(docs.union(target), ["doc_id", "text", "target"], ["doc_id", "text"], local, combine, finish, "doc_id long, n_words long, target_bits double, background_bits double, score double")


def op6_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Every document's cross-entropy difference between the benchmark's model and the corpus's own."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    out = cross_entropy_difference(read("documents"), read("benchmark"))
    return out.select("doc_id", "n_words", F.round("target_bits", 6).alias("target_bits"), F.round("background_bits", 6).alias("background_bits"), F.round("score", 6).alias("score"))


OP6_SQL = rf"""
WITH t AS (
  SELECT doc_id, text, 0 AS tg FROM documents UNION ALL SELECT -1 - item_id, text, 1 FROM benchmark),
l AS (SELECT doc_id, tg, list_filter(regexp_split_to_array(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM t),
p AS (SELECT doc_id, tg, ws, unnest(range(1, len(ws) + 1)) AS i FROM l),
o AS (SELECT doc_id, tg, i, ws[i] AS w, CASE WHEN i > 1 THEN ws[i - 1] END AS v FROM p),
cw AS (SELECT w, count(*) AS b, sum(tg) AS t FROM o GROUP BY w),
cp AS (SELECT v, w, count(*) AS b, sum(tg) AS t FROM o WHERE v IS NOT NULL GROUP BY v, w),
mw AS (SELECT doc_id, w, count(*) AS n FROM o GROUP BY doc_id, w),
mp AS (SELECT doc_id, v, w, count(*) AS n FROM o WHERE v IS NOT NULL GROUP BY doc_id, v, w),
z AS (SELECT doc_id, count(*) AS n FROM o GROUP BY doc_id),
tt AS (SELECT CAST(count(*) AS DOUBLE) AS b, CAST(sum(tg) AS DOUBLE) AS t FROM o),
u AS (SELECT o.doc_id, o.v, z.n AS n,
    (cw.t + {PRIOR_WORD} * cw.b / tt.b) / (tt.t + {PRIOR_WORD}) AS pt,
    (cw.b - cw.t - mw.n + {PRIOR_WORD} * cw.b / tt.b) / (tt.b - tt.t - z.n + {PRIOR_WORD}) AS pb,
    cv.t AS vt, cv.b - cv.t - mv.n AS vb, cp.t AS jt, cp.b - cp.t - mp.n AS jb
  FROM o JOIN cw ON o.w = cw.w JOIN mw ON o.doc_id = mw.doc_id AND o.w = mw.w JOIN z ON o.doc_id = z.doc_id CROSS JOIN tt
  LEFT JOIN cw cv ON o.v = cv.w LEFT JOIN mw mv ON o.doc_id = mv.doc_id AND o.v = mv.w
  LEFT JOIN cp ON o.v = cp.v AND o.w = cp.w LEFT JOIN mp ON o.doc_id = mp.doc_id AND o.v = mp.v AND o.w = mp.w
  WHERE o.tg = 0),
s AS (SELECT doc_id, max(n) AS n,
    avg(-log2(CASE WHEN v IS NULL THEN pt ELSE (jt + {PRIOR_PAIR} * pt) / (vt + {PRIOR_PAIR}) END)) AS ht,
    avg(-log2(CASE WHEN v IS NULL THEN pb ELSE (jb + {PRIOR_PAIR} * pb) / (vb + {PRIOR_PAIR}) END)) AS hb
  FROM u GROUP BY doc_id)
SELECT l.doc_id, CAST(len(l.ws) AS BIGINT) AS n_words, round(s.ht, 6) AS target_bits, round(s.hb, 6) AS background_bits,
  round(s.ht - s.hb, 6) AS score
FROM l LEFT JOIN s ON l.doc_id = s.doc_id WHERE l.tg = 0
"""
