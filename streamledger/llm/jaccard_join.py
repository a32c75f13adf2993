"""N-gram Jaccard join by a token-group matrix.

1. Every document becomes the set of its distinct word shingles. The corpus-wide document frequency of each shingle
   comes from ``exchange``. Only shingles in two documents or more can be shared, so a document keeps these alone,
   rarest first. Documents that link share one of each other's first ``n - ceil(t n) + 1`` shingles in that order
   (prefix filter); a document with so many shingles of its own links with nothing.
2. Equal sets collapse to their smallest document.
3. Similar documents form groups: documents with the same min-hash are held against the most central of them (the one whose shingles are most frequent), and those
   that link with it carry its label. Three min-hashes are tried in turn on what is left without a label. A label's
   documents, cut into pieces of bounded size, are the groups; the union of a group's shingles is stored once.
4. The matrix of groups by tokens is looked up by prefix: a document asks for a group of another label only if they share a prefix
   shingle, and their sizes and the shingle's place in the order allow a link (positional filter). What it asks for is held against the
   stored unions: the shingles it has in the union bound its overlap with every member.
5. Only groups whose bound reaches what a link needs are opened: their members are read, and the document is compared with each.
6. Documents of one label are compared with each other, in cells of two blocks of bounded size: products of 0/1 matrices.
7. Links give connected components; a document's number of links is summed over cells, weighted by the copies of its partners.

Two documents link when ``100 * |A n B| >= percent * |A u B|``. No cap on partners or candidates.
Exact copies cost one comparison a copy, not one a pair. Cells return numbers of links, not pairs.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .exchange import distinct, exchange, expand
from .runtime import materialize, spread
from .words import mix, shingle_sets, text_buffer

_SETS = "doc_id long, n_shingles long, copy_of long, digest binary, central long, k0 long, k1 long, k2 long, prefix int, tokens binary, c long"
_SEEDS = [np.uint64(x) for x in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0xA54FF53A5F1D36F1)]
GROUP = 64  # members of a group
QUERIES = 256  # documents that one task opens a group for
BLOCK, BLOCK_BYTES = 512, 8 << 20  # documents of a label, and bytes of their shingles, in a block
_UNIONS = pa.schema([("label", pa.int64()), ("piece", pa.int64()), ("least", pa.int64()), ("union", pa.binary())])
_DEGREES = "id long, degree long, low long"


def _sets(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, and for documents that may link: digest, min-hashes, prefix length, shared shingles rarest first, rows of the chunk with the same set)."""

    def sets(table: pa.Table):
        data, offsets = text_buffer(table["text"])
        return shingle_sets(data, offsets, words)

    def local(table: pa.Table):
        keys, count = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets(table)]), return_counts=True)
        return keys, [count.astype(np.int64)]

    def combine(starts, order, values):
        return [expand(np.add.reduceat(values[0][order], starts), starts, order)]

    def finish(table: pa.Table, answers):
        each = sets(table)
        keys, _, inverse = distinct(list(each))
        df = answers.pop()[inverse] if len(keys) else np.zeros(0, np.int64)
        del keys, inverse
        ids, at = table["doc_id"].to_pylist(), 0
        first: dict[bytes, int] = {}
        count: Counter[bytes] = Counter()
        rows: list[list] = []
        for i, x in zip(ids, each, strict=True):
            n, f = len(x), df[at : at + len(x)]
            at += n
            shared = f >= 2
            prefix = n - -(-percent * n // 100) + 1 - (n - int(shared.sum()))
            rows.append([n, *[None] * 9])
            if n == 0 or prefix <= 0 or i is None:
                continue
            digest = hashlib.blake2b(x.tobytes(), digest_size=16).digest()
            low = [int(mix(x ^ s).min().view(np.int64)) for s in _SEEDS]
            tokens, f = x[shared], f[shared]
            order = np.lexsort((tokens, f))
            rows[-1][1:] = [None, digest, int(f.sum()) * 1000 // n, *low, min(prefix, len(tokens)), tokens[order].tobytes(), None]
            first[digest] = min(i, first.get(digest, i))
            count[digest] += 1
        seen = set()
        for i, row in zip(ids, rows, strict=True):
            if row[2] is not None:
                row[1] = first[row[2]]
                if row[1] != i or i in seen:  # a copy within the chunk: its smallest document stands for it
                    row[2:] = [None] * 8
                else:
                    row[9] = count[row[2]]
                    seen.add(i)
        columns = list(zip(*rows, strict=True))
        kinds = [pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4, pa.int32(), pa.binary(), pa.int64()]
        names = ["n_shingles", "copy_of", "digest", "central", "k0", "k1", "k2", "prefix", "tokens", "c"]
        return pa.table({"doc_id": table["doc_id"].combine_chunks()} | {c: pa.array(v, t) for c, v, t in zip(names, columns, kinds, strict=True)})

    return exchange(docs, ["doc_id", "text"], ["doc_id", "text"], local, combine, finish, _SETS)


def _links(x: np.ndarray, nx: int, y: np.ndarray, ny: int, percent: int) -> bool:
    """x and y hold the shared shingles only; what is not shared is in no intersection."""
    if percent * max(nx, ny) > 100 * min(nx, ny):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (nx + ny - both)


def _with_leader(percent: int):
    def check(batches):
        for t in batches:
            columns = [t.column(c).to_pylist() for c in ("doc_id", "n_shingles", "tokens", "leader", "leader_n", "leader_tokens")]
            rows = [(d, lead) for d, n, x, lead, m, y in zip(*columns, strict=True) if _links(np.frombuffer(x, np.uint64), n, np.frombuffer(y, np.uint64), m, percent)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["doc_id", "leader"])

    return check


def _explode_prefix(batches):
    for t in batches:
        prefix = t.column("prefix").to_numpy().astype(np.int64)
        tokens = [np.frombuffer(x, np.int64, int(p)) for x, p in zip(t.column("tokens").to_pylist(), prefix, strict=True)]
        shared = np.array([len(x) // 8 for x in t.column("tokens").to_pylist()], np.int64)
        start = np.cumsum(prefix) - prefix
        rest = np.repeat(shared + start, prefix) - np.arange(int(prefix.sum()))
        repeat = lambda c: pa.array(np.repeat(t.column(c).to_numpy(), prefix))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *tokens])), pa.array(rest), *(repeat(c) for c in ("doc_id", "n_shingles", "label", "size", "piece"))], ["token", "rest", "doc_id", "n_shingles", "label", "size", "piece"])


def _union(key, members):
    """A group's stored row: the union of its members' shingles, sorted, and its least and most shingles."""
    union = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in members["tokens"].to_pylist()]))
    return pa.table({"label": [key[0].as_py()], "piece": [key[1].as_py()], "least": [pc.min(members["n_shingles"]).as_py()], "union": pa.array([union.tobytes()], pa.binary())}, _UNIONS)


def _bound(percent: int):
    """The queries whose overlap with a group's union reaches what a link with some member needs, with that bound."""

    def check(groups, queries):
        found: list[tuple] = []
        for label, piece, least, union in zip(*(groups[c].to_pylist() for c in ("label", "piece", "least", "union")), strict=True):
            union = np.frombuffer(union, np.uint64)
            for q, n, x in zip(*(queries[c].to_pylist() for c in ("query", "query_n", "query_tokens")), strict=True):
                x = np.frombuffer(x, np.uint64)
                at = np.minimum(np.searchsorted(union, x), len(union) - 1)
                bound = int((union[at] == x).sum())
                if 100 * bound >= percent * max(n, least):
                    found.append((label, piece, q, bound))
        columns = zip(*found, strict=True) if found else ((), (), (), ())
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("label", "piece", "query", "bound"), columns, strict=True)})

    return check


def _open_groups(percent: int):
    """For each query its links with members of the group and one of them (all members are connected), and for each member its links with queries."""

    def check(members, queries):
        degree: Counter[int] = Counter()
        low: dict[int, int] = {}
        if members.num_rows and queries.num_rows:
            ids, sizes, copies = (members[c].to_pylist() for c in ("doc_id", "n_shingles", "c"))
            each = [np.frombuffer(x, np.uint64) for x in members["tokens"].to_pylist()]
            for q, n, cq, bound, x in zip(*(queries[c].to_pylist() for c in ("query", "query_n", "query_c", "bound", "query_tokens")), strict=True):
                x = np.frombuffer(x, np.uint64)
                for m, ny, cm, y in zip(ids, sizes, copies, each, strict=True):
                    if m != q and 100 * bound >= percent * max(n, ny) and _links(x, n, y, ny, percent):
                        degree[q] += cm
                        degree[m] += cq
                        low.setdefault(q, m)
        return pa.table({"id": pa.array(degree, pa.int64()), "degree": pa.array(degree.values(), pa.int64()), "low": pa.array([low.get(i) for i in degree], pa.int64())})

    return check


def _shared(tokens: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many shingles each set of ``a`` has in common with each of ``b`` (positions in ``tokens``)."""
    row = np.repeat(np.arange(len(tokens)), [len(x) for x in tokens])
    _, column, df = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    keep = df[column] >= 2
    row, column = row[keep], (np.cumsum(df >= 2) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = max(1024, (1 << 21) // len(tokens))
    out = np.zeros((len(a), len(b)), np.int64)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        i, j = np.searchsorted(column, [start, start + width])
        m = np.zeros((len(tokens), int(column[j - 1]) - start + 1), np.float32)  # sums below 2^24 are exact
        m[row[i:j], column[i:j] - start] = 1
        out += (m[a] @ m[b].T).astype(np.int64)
    return out


def _within(percent: int):
    """Links between two blocks of a label, or inside one; its documents are connected by their leader."""

    def check(key, cell):
        block, ids, n, c = (cell[x].to_numpy() for x in ("block", "doc_id", "n_shingles", "c"))
        lo, hi = key[1].as_py(), key[2].as_py()
        a, b = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        degree = np.zeros(len(ids), np.int64)
        if len(a) and len(b) and len(ids) > 1:
            both = _shared([np.frombuffer(x, np.uint64) for x in cell["tokens"].to_pylist()], a, b)
            mask = (100 * both >= percent * (n[a][:, None] + n[b] - both)) & (ids[a][:, None] != ids[b])
            degree[a] += mask @ c[b]
            if lo != hi:
                degree[b] += c[a] @ mask
        some = degree > 0
        return pa.table({"id": pa.array(ids[some]), "degree": pa.array(degree[some]), "low": pa.nulls(int(some.sum()), pa.int64())})

    return check


def jaccard_join(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, n_links: the rows it links with, component_id: the smallest doc_id reachable by links, itself included).

    Texts are lower-cased in A-Z. A null or blank text has no shingles and links with nothing; a text of fewer than ``words``
    words has one shingle, all of it. doc_id has to be unique: rows that repeat one are judged one by one
    and share its component and the largest n_links. A row without doc_id is returned with a null component and no link. A very long text is
    one set, whole. Equal sets count one link for each copy, the smallest doc_id stands for them; ties of central leaders go to the smallest doc_id.
    An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = materialize(_sets(docs, words, percent), "sets")
    near = sets.where("digest IS NOT NULL")
    head = near.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.sum("c").alias("c"))
    # a digest has a row a chunk at most
    copies = materialize(near.select("doc_id", "digest").join(head, "digest").select(F.col("doc_id").alias("chunk_rep"), "rep", "digest", "c"), "copies")
    reps = copies.where("chunk_rep = rep").select(F.col("rep").alias("doc_id"), "digest", "c")
    if reps.groupBy("doc_id", "digest").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        reps = near.drop("c").join(reps, ["doc_id", "digest"])
    else:  # a doc_id that repeats with its text in several chunks
        reps = near.drop("c").dropDuplicates(["doc_id", "digest"]).join(reps.distinct(), ["doc_id", "digest"])
    reps = materialize(reps.drop("digest", "copy_of"), "reps")

    labels = None
    left = reps
    for k in ("k0", "k1", "k2"):
        heads = left.groupBy(k).agg(F.max(F.struct("central", -F.col("doc_id"))).alias("top"), F.count("*").alias("c")).where("c > 1").select(k, (-F.col("top.col2")).alias("leader"))
        lead = heads.join(reps.select(F.col("doc_id").alias("leader"), F.col("n_shingles").alias("leader_n"), F.col("tokens").alias("leader_tokens")), "leader")
        pairs = left.join(lead, k).where("doc_id <> leader").select("doc_id", "n_shingles", "tokens", "leader", "leader_n", "leader_tokens")
        found = materialize(pairs.mapInArrow(_with_leader(percent), "doc_id long, leader long"), "leaders")
        labels = found if labels is None else labels.union(found)
        left = left.join(found, "doc_id", "left_anti")
    attached = labels
    sizes = spread(attached.groupBy("leader").agg(F.count("*").alias("c")))
    known = reps.select("doc_id").join(attached, "doc_id", "left").select("doc_id", F.coalesce("leader", "doc_id").alias("label"))
    known = known.join(sizes, known.label == sizes.leader, "left").select("doc_id", "label", (F.coalesce("c", F.lit(0)) + 1).alias("size"))
    known = known.withColumn("piece", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("size") / GROUP).cast("long")))
    grouped = materialize(reps.drop("k0", "k1", "k2").join(known, "doc_id"), "grouped")

    rows = materialize(grouped.select("doc_id", "n_shingles", "label", "size", "piece", "prefix", "tokens").mapInArrow(_explode_prefix, "token long, rest long, doc_id long, n_shingles long, label long, size long, piece long"), "postings")
    rank = F.struct("size", "label")
    shared = spread(rows.groupBy("token").agg(F.min(rank).alias("low"), F.max(rank).alias("high")).where("low < high"))
    queries = rows.join(shared, "token").where(rank < F.col("high")).select("token", "rest", "doc_id", "n_shingles", rank.alias("rank"))
    groups = rows.join(shared, "token").where(rank > F.col("low")).groupBy("token", "label", "size", "piece").agg(F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most"), F.max("rest").alias("group_rest"))
    groups = groups.select("token", "label", "piece", rank.alias("group_rank"), "least", "most", "group_rest")
    # at the first shingle a pair shares, what follows in either order has to hold all that a link needs
    fits = f"rank < group_rank AND {percent} * least <= 100 * n_shingles AND {percent} * n_shingles <= 100 * most"
    fits += f" AND {100 + percent} * least(rest, group_rest) >= {percent} * (n_shingles + least)"
    pairs = materialize(queries.join(groups, "token").where(fits).select("doc_id", "label", "piece").distinct(), "candidates")

    unions = materialize(grouped.groupBy("label", "piece").applyInArrow(_union, "label long, piece long, least long, union binary"), "unions")
    sought = grouped.select(F.col("doc_id").alias("query"), F.col("n_shingles").alias("query_n"), F.col("c").alias("query_c"), F.col("tokens").alias("query_tokens"))

    def salted(asked: DataFrame, held: DataFrame):
        """Queries and the groups they ask for, a group that many ask for once for each ``QUERIES`` of them."""
        salts = spread(asked.groupBy("label", "piece").agg(F.ceil(F.count("*") / QUERIES).cast("long").alias("salts")))
        asked = asked.join(salts, ["label", "piece"]).withColumn("salt", F.pmod(F.xxhash64("query"), F.col("salts"))).withColumnsRenamed({"label": "l", "piece": "p", "salt": "s"}).drop("salts").join(sought, "query")
        held = held.join(salts, ["label", "piece"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        return held.repartition("label", "piece", "salt").groupBy("label", "piece", "salt").cogroup(asked.repartition("l", "p", "s").groupBy("l", "p", "s"))

    asked = pairs.select(F.col("doc_id").alias("query"), "label", "piece")
    passed = materialize(salted(asked, unions).applyInArrow(_bound(percent), "label long, piece long, query long, bound long"), "passed")
    opened = salted(passed, grouped.select("label", "piece", "doc_id", "n_shingles", "c", "tokens")).applyInArrow(_open_groups(percent), _DEGREES)

    several = grouped.where("size > 1")
    blocks = spread(several.groupBy("label").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(F.octet_length("tokens")) / BLOCK_BYTES)).cast("long").alias("blocks")))
    inside = several.join(blocks, "label").withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    inside = inside.select("label", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "doc_id", "n_shingles", "c", "tokens")
    # dealt by cell, not by label as the join above is: a label may hold a third of all documents
    within = inside.repartition("label", "lo", "hi").groupBy("label", "lo", "hi").applyInArrow(_within(percent), _DEGREES)

    links = materialize(opened.union(within), "links")
    # rows that repeat a doc_id are one node, whatever their texts: it is tied to what each is a copy of
    owned = sets.where("copy_of IS NOT NULL").select(F.col("doc_id").alias("a"), "copy_of")
    repeated = owned.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
    ties = owned.union(copies.select(F.col("chunk_rep").alias("a"), "rep")).join(repeated, "a", "left_semi")
    edges = attached.select(F.col("doc_id").alias("a"), F.col("leader").alias("b")).union(links.where("low IS NOT NULL").select("id", "low")).union(ties)
    whole = components(edges)
    degrees = links.groupBy(F.col("id").alias("linked")).agg(F.sum("degree").alias("degree"))

    of = copies.join(whole, copies.rep == whole.id, "left").join(degrees, copies.rep == degrees.linked, "left")
    of = of.select("chunk_rep", F.coalesce("component", "rep").alias("component"), (F.coalesce("degree", F.lit(0)) + F.col("c") - 1).alias("n"))
    of = of.groupBy("chunk_rep").agg(F.min("component").alias("component"), F.max("n").alias("n"))
    # only documents that may link are joined: a null key for all others would meet in one task
    linked = sets.where("copy_of IS NOT NULL").select("doc_id", "n_shingles", "copy_of").join(of, F.col("copy_of") == F.col("chunk_rep"))
    alone = sets.where("copy_of IS NULL").select("doc_id", "n_shingles", F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id"))
    return linked.select("doc_id", "n_shingles", F.col("n").alias("n_links"), F.col("component").alias("component_id")).union(alone)


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``jaccard_join`` without its n_links."""
    return jaccard_join(docs, words, percent).drop("n_links")


def op1_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Shingle counts and components of all documents; five words, a similarity of 0.8 or more."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), 5, 80)


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+4], ' ') AS k FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT a.doc_id AS x, c.doc_id AS y, count(*) AS shared FROM s a JOIN s c ON a.k = c.k AND a.doc_id <> c.doc_id GROUP BY a.doc_id, c.doc_id),
l AS (SELECT x, y FROM b JOIN n nx ON b.x = nx.doc_id JOIN n ny ON b.y = ny.doc_id WHERE 100 * shared >= 80 * (nx.n + ny.n - shared)),
r AS (SELECT x AS id, x AS node FROM l UNION SELECT r.id, l.y FROM r JOIN l ON r.node = l.x),
c AS (SELECT id, min(node) AS low FROM r GROUP BY id)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.low, w.doc_id) AS component_id
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN c ON w.doc_id = c.id
"""
