"""Deletes of now against their SQL, on logs that reach beyond a million."""

from __future__ import annotations

import duckdb
import pytest

from streamledger.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def long_log(tmp_path_factory):
    """The smallest events, and again with ids from 5,000,000."""
    path = tmp_path_factory.mktemp("long")
    rows = f"SELECT * FROM '{DATA}/events.parquet'"
    duckdb.execute(f"COPY ({rows} UNION ALL SELECT * REPLACE (event_id + 5000000 AS event_id) FROM ({rows})) TO '{path}/events.parquet' (FORMAT parquet)")
    return path


@pytest.mark.parametrize("name", ["delete_stats", "delete_tag_glob", "delete_tag_eq"])
def test_deletes_reach_the_head(spark, long_log, name):
    df = QUERIES[name](spark, str(long_log))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{long_log}/events.parquet'")
    found = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert len(found) > 0 and sorted(map(tuple, df.collect())) == sorted(found)
