"""Routers over logs longer than one pass."""

from __future__ import annotations

import pytest

from streamledger.config import ROUTER_BATCH
from streamledger.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.01"  # 10,000 events, ten passes
LOGS = [f"router_{x}_log" for x in ("forward", "filter", "clear_node_tag", "exactly_once", "hop_cap", "backpressure")]


@pytest.mark.parametrize("name", LOGS)
def test_whole_log_reaches_the_head(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{DATA}/events.parquet'")
    df = QUERIES[name](spark, DATA)
    found = con.execute(ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    rows = df.select(*names).collect()
    assert sorted((tuple(r) for r in rows), key=repr) == sorted(found.fetchall(), key=repr)
    assert max(r["source_seq"] for r in rows) > ROUTER_BATCH
