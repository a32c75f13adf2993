"""Invariants over random histories, against a replica in plain Python."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from streamledger.functions import exprs as X
from streamledger.errors import LedgerError
from streamledger.operators import append as A
from streamledger.operators import queue as Q
from streamledger.operators import retention as T
from streamledger.operators.router import check_cycle

LOG = "topic string, seq long, ts_ms long, node string, tag string, bytes long"


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 500), st.integers(1, 40)), min_size=1, max_size=40), st.integers(0, 900), st.integers(0, 20), st.integers(0, 300))
def test_floors(spark, rows, ttl, cap, cap_bytes):
    ts = 0
    log = []
    for i, (step, size) in enumerate(rows):
        ts += step
        log.append(("t", i + 1, ts, None, None, size))
    now = ts + 100
    head = len(log)
    expiry = 0
    for _, s, t, *_ in log:
        if not (ttl and now - t > ttl):
            break
        expiry = s
    kept, size_floor = 0, 0
    for r in reversed(log):
        kept += r[5]
        if cap_bytes and kept > cap_bytes:
            size_floor = r[1]
            break
    got = T.floors(spark.createDataFrame(log, LOG), now, ttl, cap, cap_bytes).first()
    assert got["expiry_floor"] == expiry
    assert got["evict_floor"] == max(max(head - cap, 0) if cap else 0, size_floor)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 400)), min_size=1, max_size=60), st.integers(0, 600))
def test_idempotent_writes(spark, rows, window):
    ts, writes, want, open_ = 0, [], [], {}
    for i, (k, step) in enumerate(rows):
        ts += step
        key = f"k{k}" if k else None
        writes.append((i, key, ts))
        new = key is None or key not in open_ or ts - open_[key][0] > window
        if key is not None and new:
            open_[key] = (ts, i)
        want.append((i, new, i if key is None else open_[key][1]))
    got = A.idempotent_writes(spark.createDataFrame(writes, "pos long, idem_key string, ts_ms long"), window)
    assert sorted((r["pos"], r["accepted"], r["original_pos"]) for r in got.collect()) == want


@settings(max_examples=6, deadline=None)
@given(st.lists(st.integers(0, 7), min_size=1, max_size=5), st.integers(0, 20))
def test_cohort_is_round_robin(spark, wants, jobs):
    ready = spark.createDataFrame([(i * 3 + 1,) for i in range(jobs)], "seq long")
    claimers = spark.createDataFrame([(i, f"n{i}", m, 1000) for i, m in enumerate(wants)], "ord int, node string, max int, lease_ms long")
    got = {r["seq"]: r["node"] for r in Q.cohort(ready, claimers, 1, 0).collect()}
    left, want, queue = list(wants), {}, [i * 3 + 1 for i in range(jobs)]
    while queue and any(left):
        for i, n in enumerate(left):
            if n and queue:
                want[queue.pop(0)] = f"n{i}"
                left[i] -= 1
    assert got == want


def test_prefix_sums_over_blocks(spark):
    rows = [("t", i, i % 5) for i in range(0, 400_000, 3001)]
    got = A.prefix_sums(spark.createDataFrame(rows, "topic string, seq long, bytes long"), ["topic"], "seq", "bytes", "c")
    total, want = 0, {}
    for _, s, b in rows:
        total += b
        want[s] = total
    assert {r["seq"]: r["c"] for r in got.collect()} == want


@pytest.mark.parametrize(("spec", "op", "value"), [("a", "Eq", "a"), ("a*", "Glob", "a"), ("a**", "Glob", "a*"), (["tag", "Eq", "a*"], "Eq", "a*"), (["tag", "Glob", "%_"], "Glob", "%_")])
def test_tag_filters(spec, op, value):
    assert X.TagFilter.parse(spec) == X.TagFilter(op, value)


@pytest.mark.parametrize("spec", [["node", "Eq", "a"], ["tag", "Like", "a"], ["tag", "Eq"], 7])
def test_bad_filters(spec):
    with pytest.raises(LedgerError):
        X.TagFilter.parse(spec)


def test_cursors():
    assert X.page_after(X.page_token("name")) == "name"
    assert X.parse_composite(X.composite_cursor({"b": 2, "a": 1})) == {"a": 1, "b": 2}
    for bad in ("***", "AAAA"):
        with pytest.raises(LedgerError):
            X.page_after(bad)


def test_cycles():
    edges = [("a", "b"), ("b", "c")]
    check_cycle(edges, "a", "c")
    with pytest.raises(LedgerError) as e:
        check_cycle(edges, "c", "a")
    assert e.value.detail["path"] == ["a", "b", "c"]
    check_cycle(edges, "c", "a", allow=True)
