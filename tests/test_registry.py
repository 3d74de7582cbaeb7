"""Registered queries against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from tracelake import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return c


def rows(columns, table):
    fixed = lambda x: round(x, 5) if isinstance(x, float) else x
    return sorted(tuple(str(fixed(r[c])) for c in columns) for r in table)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, con, name):
    got = registry.queries()[name](spark, SF)
    found = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    want = [dict(zip(names, r)) for r in found.fetchall()]
    assert rows(names, [r.asDict() for r in got.collect()]) == rows(names, want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0
