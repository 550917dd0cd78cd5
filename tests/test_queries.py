"""Every registered query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from usagebook.plans import queries


@pytest.fixture(scope="module")
def con(sf):
    out = duckdb.connect()
    out.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf):
        out.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return out


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, sf, con, name):
    got = queries.QUERIES[name](spark, sf)
    cursor = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(got.columns) == sorted(names)
    rows = lambda found, at: sorted((tuple(r[i] for i in at) for r in found), key=repr)
    order = sorted(names)
    assert rows(got.collect(), [got.columns.index(c) for c in order]) == rows(cursor.fetchall(), [names.index(c) for c in order])


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
