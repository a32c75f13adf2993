"""Toxicity by a weighted lexicon, matched with Aho-Corasick after folding.

Folding maps each character to its skeleton: case, accents, full-width forms and look-alike letters of other
scripts, digits that stand for letters, and one class for i and l; everything else that is no letter becomes a space.
The lexicon holds skeleton words and word beginnings (``" stem"``) whose weight is their log-odds in labelled
texts. A hit inside an exception phrase (a word and a neighbour that clean texts use) does not count.
The sum of weights is normalised by length and mapped to 0..1 by a logistic curve.

Fit: only on a bounded sample of labelled texts (``MAX_TOXIC``, ``MAX_CLEAN`` rows, the smallest hashes of doc_id). A
term counts once for each min-hash of the texts it is in, so near copies of one text support no term. The curve is
fitted across folds: each half is scored with the terms of the other half.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import local_rows, materialize, partitions, small_batches

MAX_TOXIC, MAX_CLEAN = 6000, 12000
SUPPORT = 2  # distinct toxic texts a term needs
STEMS = (4, 5, 6, 7)
THRESHOLD = 0.7
LEAST_WEIGHT = 2.5
PADDING = 20.0  # words added to a text's length
SLICE, SLICE_BYTES = 128, 1 << 20  # texts that a worker holds as Python objects
PAIRS = 50_000  # distinct pairs that a worker gathers before it sends them

# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o",
    "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԝ": "w", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o",
    "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ß": "ss",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SAME = {"l": "i"}
_TABLE: np.ndarray | None = None


def _skeleton(c: str) -> str:
    c = unicodedata.normalize("NFKD", c.casefold())[:1] or " "
    c = HOMOGLYPHS.get(c, c)[:1]
    c = DIGITS.get(c, c)
    c = SAME.get(c, c)
    return c if c.isalpha() else " "


def _table() -> np.ndarray:
    """Code point to skeleton, by rule; code points past the basic plane are themselves."""
    global _TABLE
    if _TABLE is None:
        _TABLE = np.array([ord(_skeleton(chr(i))) if not 0xD800 <= i < 0xE000 else 0x20 for i in range(0x10000)], np.uint32)
    return _TABLE


def fold(text: str | None) -> str:
    """The skeleton, with a space before and after. Marks that combine with the letter before are dropped."""
    if not text:
        return "  "
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    points = points[(points < 0x300) | (points > 0x36F)]
    table = _table()
    small = points < 0x10000
    out = np.where(small, table[np.where(small, points, 0)], points)
    return " " + out.astype(np.uint32).tobytes().decode("utf-32-le", "replace") + " "


def _features(words: set[str]) -> set[str]:
    out = set(words)
    for w in words:
        out |= {"^" + w[:n] for n in STEMS if len(w) > n}
    return out


@dataclass
class Lexicon:
    """Terms with weights: ``word`` matches a whole word, ``^stem`` the beginning of one."""

    terms: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    slope: float = 3.0
    middle: float = -4.5

    def automaton(self):
        a = ahocorasick.Automaton()
        for t, w in self.terms.items():
            a.add_word(f" {t[1:]}" if t[0] == "^" else f" {t} ", (1, w, len(t) - 1 if t[0] == "^" else len(t) + 1))
        for p in self.exceptions:
            a.add_word(f" {p} ", (0, 0.0, len(p) + 1))
        if len(a):
            a.make_automaton()
        return a


def weigh(automaton, folded: str) -> float:
    """Sum of the weights; each word counts once, with the heaviest term that hits it, unless an exception phrase covers it. Linear in hits."""
    if not len(automaton):
        return 0.0
    hits: dict[int, float] = {}
    covered: list[tuple[int, int]] = []
    for end, (kind, w, size) in automaton.iter(folded):
        at = end - size
        if kind:
            if w > hits.get(at, -math.inf):
                hits[at] = w
        else:
            covered.append((at, end))
    covered.sort()
    total, span, upto = 0.0, 0, -1
    for i in sorted(hits):
        while span < len(covered) and covered[span][0] <= i:
            upto = max(upto, covered[span][1])
            span += 1
        if i >= upto:
            total += hits[i]
    return total


def _density(total: float, folded: str) -> float:
    """Natural logarithm of weight a word; -20 without a hit."""
    return math.log(total / (len(folded.split()) + PADDING)) if total > 0 else -20.0


def _logistic(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def _slices(batches, column: str):
    """Batches of at most ``SLICE`` rows and about ``SLICE_BYTES`` of text (a longer text by itself): what a worker holds as Python objects at a time."""
    for t in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(t.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < t.num_rows:
            b = int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + SLICE_BYTES, "right"))
            b = min(max(a + 1, b), a + SLICE)
            yield t.slice(a, b - a)
            a = b


def _counts(batches):
    """Rows (min-hash, label, feature) of each text; a null feature stands for the text itself."""
    for t in _slices(batches, "text"):
        sig, of, features = [], [], []
        for i, x in enumerate(t.column("text").to_pylist()):
            words = set(fold(x).split())
            sig.append(min(map(hash_word, words), default=0))
            own = [None, *sorted(_features(words))]
            features += own
            of += [i] * len(own)
        of = pa.array(of, pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(sig, pa.int64()).take(of), t.column("toxic").take(of), pa.array(features, pa.string())], ["sig", "toxic", "term"])


def hash_word(w: str) -> int:
    return xxhash.xxh64_intdigest(w.encode("utf-8", "replace")) >> 1


def _weight(support: str, n_toxic: int, against: str, n_clean: int):
    """Log-odds of a term, as a column."""
    return F.log((F.col(support) + 0.5) / (n_toxic + 1)) - F.log((F.col(against) + 0.5) / (n_clean + 1))


def _neighbours(words_wanted: frozenset[str]):
    """Each lexicon word with the word before and after it, by label."""

    def send(pairs: Counter):
        a, b, c = zip(*((label, p, n) for (label, p), n in pairs.items()), strict=True) if pairs else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.string()), pa.array(c, pa.int64())], ["label", "pair", "c"])

    def run(batches):
        pairs = Counter()
        for t in _slices(batches, "text"):
            for text, label in zip(t.column("text").to_pylist(), t.column("toxic").to_pylist(), strict=True):
                words = fold(text).split()
                for i, w in enumerate(words):
                    if w in words_wanted:
                        if i:
                            pairs[(label, f"{words[i - 1]} {w}")] += 1
                        if i + 1 < len(words):
                            pairs[(label, f"{w} {words[i + 1]}")] += 1
            if len(pairs) > PAIRS:
                yield send(pairs)
                pairs = Counter()
        yield send(pairs)

    return run


def learn(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """Fit a lexicon on at most ``max_toxic`` + ``max_clean`` labelled texts.

    ``labels`` has doc_id and toxic (0 or 1; others are ignored). No usable label gives an empty lexicon.
    ``exceptions`` are phrases that never count, besides those learned.
    """
    usable = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    pick = lambda v, n: usable.where(f"toxic = {v}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    sample = [(r[0], r[1]) for r in pick(1, max_toxic).union(pick(0, max_clean)).collect()]  # bounded by the two limits
    if not sample:
        return Lexicon({}, list(exceptions))
    spark = small_batches(docs).sparkSession
    ids = F.broadcast(local_rows(spark, sample, "doc_id long, toxic int"))
    rows = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id").repartition(partitions(spark)), "toxic-sample")
    # distinct min-hashes of each term by label and half; those of the null term are the numbers of texts
    seen = rows.mapInArrow(_counts, "sig long, toxic int, term string").repartition("term").groupBy("term", "sig", "toxic").agg(F.lit(1).alias("one"))
    number = lambda v, h: F.sum(F.when((F.col("toxic") == v) & (F.col("sig") % 2 == h), 1).otherwise(0))
    counts = seen.groupBy("term").agg(*[number(v, h).alias(f"{c}{h}") for v, c in ((1, "n"), (0, "b")) for h in (0, 1)])
    counts = counts.withColumns({"n": F.col("n0") + F.col("n1"), "b": F.col("b0") + F.col("b1")})
    counts = materialize(counts.where(f"term IS NULL OR n >= {SUPPORT}"), "toxic-terms")
    size = counts.where("term IS NULL").first()
    if size is None:  # no labelled document is there
        return Lexicon({}, list(exceptions))
    n_toxic, n_clean = [size["n0"], size["n1"]], [size["b0"], size["b1"]]
    terms = counts.where("term IS NOT NULL")
    terms = terms.withColumn("w", _weight("n", sum(n_toxic), "b", sum(n_clean)))
    for h in (0, 1):
        terms = terms.withColumn(f"w{h}", _weight(f"n{h}", n_toxic[h], f"b{h}", n_clean[h]))
    qualify = [f"(n{h} >= {SUPPORT} AND w{h} >= {LEAST_WEIGHT})" for h in ("", 0, 1)]
    found = terms.where(" OR ".join(qualify)).collect()  # bounded by the sample

    def lexicon_of(w: str, n: str) -> dict[str, float]:
        """Terms with enough support; the weight falls with the root of the support."""
        keep = [r for r in found if r[n] >= SUPPORT and r[w] >= LEAST_WEIGHT]
        top = max((r[n] for r in keep), default=1)
        return {r["term"]: r[w] * math.sqrt(r[n] / top) for r in keep}

    whole, folds = lexicon_of("w", "n"), [lexicon_of("w0", "n0"), lexicon_of("w1", "n1")]
    pairs = rows.mapInArrow(_neighbours(frozenset(whole)), "label int, pair string, c long").groupBy("pair").agg(
        F.sum(F.when(F.col("label") == 0, F.col("c")).otherwise(0)).alias("clean"), F.sum(F.when(F.col("label") == 1, F.col("c")).otherwise(0)).alias("toxic"))
    pairs = pairs.where("clean >= 3 AND clean >= 10 * toxic")
    phrases = sorted({fold(p).strip() for p in exceptions} | {r["pair"] for r in pairs.collect()})
    halves = [Lexicon(f, phrases) for f in folds]

    def densities(batches):
        machines = [h.automaton() for h in halves]
        for t in _slices(batches, "text"):
            x, y = [], []
            for text, label in zip(t.column("text").to_pylist(), t.column("toxic").to_pylist(), strict=True):
                folded = fold(text)
                h = min((hash_word(w) for w in set(folded.split())), default=0) % 2
                x.append(_density(weigh(machines[1 - h], folded), folded))
                y.append(label)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), pa.array(y, pa.int32())], ["x", "y"])

    points = [(r[0], r[1]) for r in rows.mapInArrow(densities, "x double, y int").collect()]  # as many as the sample
    lexicon = Lexicon(whole, phrases)
    lexicon.slope, lexicon.middle = _curve(points)
    return lexicon


def _curve(points: list[tuple[float, int]]) -> tuple[float, float]:
    """Slope and middle of a logistic curve whose 0.7 lies at the cut with the best F1 over the points."""
    points = sorted(p for p in points if p[0] > -19)
    total = sum(y for _, y in points)
    best, cut = -1.0, -5.0
    right, picked = total, len(points)
    for i, (x, y) in enumerate(points):
        f1 = 2 * right / max(1, picked + total)
        low = points[i - 1][0] if i else x - 0.5
        if f1 > best + 1e-12 and low < x:
            best, cut = f1, (x + low) / 2
        right, picked = right - y, picked - 1
    slope = 3.0
    return slope, cut - math.log(THRESHOLD / (1 - THRESHOLD)) / slope


def score(docs: DataFrame, lexicon: Lexicon, *keep: str) -> DataFrame:
    """``keep`` columns of ``docs`` (default doc_id) with score (0 to 1) and predicted (1 from 0.7 up).

    A null, empty or wordless text scores the curve's lowest value, near 0. A very long text is scored whole, in time linear in its
    length. Rows may repeat; each is scored by itself. An empty table gives no rows, an empty lexicon the lowest score everywhere.
    """
    keep = keep or ("doc_id",)
    read = "text" if "text" in keep else "_text"

    def run(batches):
        machine = lexicon.automaton()
        for t in _slices(batches, read):
            out = []
            for text in t.column(read).to_pylist():
                folded = fold(text)
                out.append(_logistic(lexicon.slope * (_density(weigh(machine, folded), folded) - lexicon.middle)))
            yield pa.RecordBatch.from_arrays([*(t.column(c) for c in keep), pa.array(out, pa.float64()), pa.array([int(x >= THRESHOLD) for x in out], pa.int32())], [*keep, "_score", "_predicted"])

    rows = small_batches(docs.select(*keep, *([] if read == "text" else [F.col("text").alias("_text")])))
    schema = ", ".join(f"`{c}` {kind}" for c, kind in docs.select(*keep).dtypes) + ", _score double, _predicted int"
    return rows.mapInArrow(run, schema)


def training_rows(labels: DataFrame) -> DataFrame:
    return labels.where("pmod(crc32(cast(cast(doc_id AS string) AS binary)), 3) <> 1")


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents; labels are learned only where crc32(doc_id) mod 3 is not 1."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    docs = read("documents")
    lexicon = learn(docs, training_rows(read("labels")))
    held = F.expr("pmod(crc32(cast(cast(doc_id AS string) AS binary)), 3) = 1")
    return score(docs, lexicon, "doc_id").select("doc_id", held.alias("held_out"), F.col("_score").alias("score"), F.col("_predicted").alias("predicted"))
