"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they count for). Tokens flow from patterns to
the sources of the pattern: a pattern's first pass through its documents costs nothing a token, each further pass
costs more than the one before (convex), up to ``max_repeats``; a source takes at most its target. The cheapest
flow that fills the targets says how many tokens each pattern gives. Then documents are selected by a seeded hash: all of a
pattern's documents for each whole pass, and for the rest those with the smallest hashes, cut where the sum is met.

Only patterns and histograms of hashes reach the driver: at most ``MAX_PATTERNS`` patterns (checked), each with a fixed
number of histogram cells. The plan has a row a pattern, so it is broadcast and a hot source stays where it is.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import local_rows, materialize

MAX_PATTERNS = 20_000
WORD = r"[^\x20\x09-\x0D]+"
CELLS = 1024
LEVELS = 4


def word_count(text: str = "text") -> Column:
    """Words of a whole text; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def share_targets(sizes: dict, weights: dict, factor: float = 1.5, cap: float = 2.0) -> dict:
    """``factor`` times all sizes dealt out by weight; a target stops at ``cap`` times its source's size, the excess is dealt anew."""
    total = factor * sum(sizes.values())
    fixed: dict = {}
    free = list(sizes)
    while free:
        rest, weight = total - sum(fixed.values()), sum(weights[s] for s in free)
        over = [s for s in free if rest * weights[s] / weight > cap * sizes[s]]
        if not over:
            return fixed | {s: rest * weights[s] / weight for s in free}
        fixed |= {s: cap * sizes[s] for s in over}
        free = [s for s in free if s not in fixed]
    return fixed


def min_cost_flow(patterns: dict[tuple, int], targets: dict, max_repeats: int) -> dict[tuple, int]:
    """Tokens each pattern gives, by least-cost flow over pass, pattern and source.

    The k-th pass of a pattern has the pattern's size as capacity and costs k - 1 a token. Nothing else costs, so a shortest
    path costs as much as the pass it starts with: pass by pass, blocking flows fill what the passes so far can
    give, and no augmentation takes back what a pattern gives. A source all of whose patterns are its own
    needs no flow. What the patterns of a source can't give stays unfilled.
    """
    room = {s: round(t) for s, t in targets.items()}
    gives = dict.fromkeys(patterns, 0)
    shared = {s for p in patterns if len(p) > 1 for s in p}
    overlapping = sorted((p for p in patterns if any(s in shared for s in p)), key=repr)
    for p, size in patterns.items():
        if len(p) == 1 and p[0] not in shared:
            gives[p] = min(size * max_repeats, room.get(p[0], 0))
    if not overlapping:
        return gives
    sources = {s: len(overlapping) + 2 + i for i, s in enumerate(sorted({s for p in overlapping for s in p}, key=repr))}
    edges: list[list[int]] = [[] for _ in range(len(overlapping) + 2 + len(sources))]
    to: list[int] = []
    cap: list[int] = []

    def edge(a: int, b: int, size: int) -> int:
        edges[a].append(len(to))
        edges[b].append(len(to) + 1)
        to.extend((b, a))
        cap.extend((size, 0))
        return len(to) - 2

    start = [edge(0, i + 2, 0) for i in range(len(overlapping))]
    for i, p in enumerate(overlapping):
        for s in p:
            edge(i + 2, sources[s], patterns[p] * max_repeats)
    for s, node in sources.items():
        edge(node, 1, room.get(s, 0))
    for _ in range(max_repeats):
        for e, p in zip(start, overlapping, strict=True):
            cap[e] += patterns[p]
        _fill(edges, to, cap)
    return gives | {p: cap[e + 1] for e, p in zip(start, overlapping, strict=True)}


def _fill(edges: list[list[int]], to: list[int], cap: list[int]) -> None:
    """Augment the flow from node 0 to node 1 to the most there is, by blocking flows on levels. Edge e runs back as e ^ 1."""
    while True:
        level = [-1] * len(edges)
        level[0], queue = 0, [0]
        for a in queue:
            for e in edges[a]:
                if cap[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[1] < 0:
            return
        turn = [0] * len(edges)
        while True:
            path: list[int] = []
            at = 0
            while at != 1:
                own = edges[at]
                while turn[at] < len(own) and not (cap[own[turn[at]]] and level[to[own[turn[at]]]] == level[at] + 1):
                    turn[at] += 1
                if turn[at] < len(own):
                    path.append(own[turn[at]])
                    at = to[path[-1]]
                elif path:
                    at = to[path.pop() ^ 1]
                    turn[at] += 1
                else:
                    break
            if at != 1:
                break
            push = min(cap[e] for e in path)
            for e in path:
                cap[e] -= push
                cap[e ^ 1] += push


def _cuts(rows: DataFrame, rest: dict[int, int]) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """Which documents of each pattern are taken once more, so that their sizes come to ``rest``: (cuts, picks).

    ``rows`` has pattern, hash (0 to 2**40 - 1) and size. Documents up to the pattern's cut are taken: level by level a
    histogram of ten more bits of the hash narrows the cell in which the sum is met; only that cell is read at the
    next level. What is then missing is filled with single picks (pattern, hash) past the cut: of each size class the
    document with the smallest hash, the largest class first, if it still fits.
    """
    spark = rows.sparkSession
    cuts, left = {p: -1 for p in rest}, dict(rest)
    open_ = {p: 0 for p, r in rest.items() if r > 0}
    for level in range(LEVELS):
        if not open_:
            break
        shift = 40 - 10 * (level + 1)
        at = local_rows(spark, list(open_.items()), "pattern int, prefix long")
        cells = rows.join(F.broadcast(at), "pattern").where(F.shiftright("hash", shift + 10) == F.col("prefix"))
        cells = cells.groupBy("pattern", F.shiftright("hash", shift).alias("cell")).agg(F.sum("size").alias("size"))
        found = defaultdict(list)
        for r in cells.collect():  # at most CELLS a pattern
            found[r["pattern"]].append((r["cell"], r["size"]))
        after = {}
        for p in open_:
            for cell, size in sorted(found[p]):
                if size > left[p]:
                    after[p] = cell
                    break
                left[p] -= size
                cuts[p] = ((cell + 1) << shift) - 1
        open_ = after
    picks: list[tuple[int, int]] = []
    for _ in range(3):
        gaps = [(p, left[p], cuts[p]) for p in rest if left[p] > 0]
        if not gaps:
            break
        taken = local_rows(spark, picks, "pattern int, hash long")
        more = rows.join(F.broadcast(local_rows(spark, gaps, "pattern int, gap long, cut long")), "pattern").where("hash > cut AND size > 0 AND size <= gap")
        more = more.join(taken, ["pattern", "hash"], "left_anti").groupBy("pattern", "hash").agg(F.sum("size").alias("size"), F.first("gap").alias("gap")).where("size <= gap")
        more = more.groupBy("pattern", F.floor(F.log2("size")).alias("class")).agg(F.min(F.struct("hash", "size")).alias("best")).collect()  # a row for each power of two
        for r in sorted(more, key=lambda r: (r["pattern"], -r["class"])):
            if r["best"]["size"] <= left[r["pattern"]]:
                left[r["pattern"]] -= r["best"]["size"]
                picks.append((r["pattern"], r["best"]["hash"]))
    return cuts, picks


def mix(docs: DataFrame, members: Column, targets: dict | None = None, weigh=None, max_repeats: int = 2, seed: int = 0, keep: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, dict]:
    """(keep columns, _size, _copies: how often the mix takes the document), and what was planned.

    ``members`` is an array of source names, in which a document may be in several. ``targets`` maps a source to its
    tokens; or ``weigh(sizes)`` makes them from the sources' sizes. A document of no source has the source None.
    A null text has size 0 and is never repeated; a very long one counts whole. Rows that repeat a doc_id, or share the hash of one, are selected together.
    Sources of equal weight are told apart by name. An empty table gives no rows. ``keep`` may name any columns but the three of the result.
    """
    pattern = F.coalesce(F.array_sort(F.array_distinct(members)), F.array().cast("array<string>"))
    pattern = F.when(F.size(pattern) == 0, F.array(F.lit(None).cast("string"))).otherwise(pattern)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*keep).alias("_keep"), word_count().alias("_size"), pattern.alias("_members"), F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 24).alias("hash"))
    rows = materialize(rows, "sizes")
    found = rows.groupBy("_members").agg(F.sum("_size").alias("size")).orderBy("_members").limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"over {MAX_PATTERNS} membership patterns")
    patterns = {tuple(r["_members"]): r["size"] for r in found}
    sizes: dict = defaultdict(int)
    for p, n in patterns.items():
        for s in p:
            sizes[s] += n
    goal = targets if targets is not None else weigh(dict(sizes))
    gives = min_cost_flow(patterns, goal, max_repeats)
    number = {p: i for i, p in enumerate(patterns)}
    whole = {number[p]: gives[p] // n if n else 0 for p, n in patterns.items()}
    rest = {number[p]: gives[p] - whole[number[p]] * n for p, n in patterns.items()}
    spark = docs.sparkSession
    numbers = local_rows(spark, [(list(p), i) for p, i in number.items()], "_members array<string>, pattern int")
    same = F.expr("transform(_members, x -> coalesce(concat('+', x), '-'))")
    tagged = rows.withColumn("_key", same).join(F.broadcast(numbers.withColumn("_key", same).drop("_members")), "_key").drop("_key") if found else rows.withColumn("pattern", F.lit(0))
    cuts, picks = _cuts(tagged.select("pattern", "hash", F.col("_size").alias("size")), rest) if found else ({}, [])
    plan = local_rows(spark, [(i, whole[i], cuts.get(i, -1)) for i in whole], "pattern int, whole long, cut long")
    picked = local_rows(spark, [(*p, 1) for p in picks], "pattern int, hash long, extra int")
    out = tagged.join(F.broadcast(plan), "pattern").join(picked, ["pattern", "hash"], "left")
    once_more = (F.col("hash") <= F.col("cut")) | F.col("extra").isNotNull()
    out = out.withColumn("_copies", F.when(F.col("_size") == 0, 0).otherwise(F.col("whole") + once_more.cast("long")))
    return out.select("_keep.*", "_size", "_members", "_copies"), {"targets": goal, "sizes": dict(sizes), "gives": gives}


def cycle_weights(sizes: dict, weights: tuple[int, ...] = (5, 2, 1)) -> dict:
    """Sources by code point, null last, weigh ``weights``, repeating."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    return share_targets({s: sizes[s] for s in order}, {s: weights[i % len(weights)] for i, s in enumerate(order)})


def op5_source_mix(spark, sf_dir: str) -> DataFrame:
    """All documents mixed to the contract's targets."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out, plan = mix(docs, F.array("source"), weigh=cycle_weights, max_repeats=2, keep=("doc_id",))
    facts = local_rows(spark, [(s, int(plan["sizes"][s]), float(plan["targets"][s])) for s in plan["sizes"]], "source string, source_size long, target double")
    out = out.withColumn("source", F.col("_members")[0])
    return out.join(F.broadcast(facts), out.source.eqNullSafe(facts.source)).select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("_copies")).alias("taken"))
