"""Every named query against its SQL, on the smallest tables: rows, names and types."""

from __future__ import annotations

import pytest

from streamledger.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
KINDS = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = duck.execute(ORACLE_SQL[name])
    names, kinds = [x[0] for x in found.description], {x[0]: str(x[1]) for x in found.description}
    assert sorted(names) == columns
    rows = found.fetchall()
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in rows), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == want
    assert {c: KINDS[k] for c, k in df.dtypes} == {c: kinds[c] for c in columns}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_streams_run(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
