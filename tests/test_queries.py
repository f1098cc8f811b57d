"""The registered queries against their SQL on small tables."""

import importlib
import os

import duckdb
import pytest

import __spark_entry__ as entry
from arborquery import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("key", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, con, key):
    df = queries.queries()[key](spark, SF)
    names = sorted(df.columns)
    found = con.execute(queries.oracle_sql()[key])
    at = [[c[0] for c in found.description].index(c) for c in names]
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=str)


def test_entry(spark):
    if os.path.isdir(SF):
        assert entry.entry(spark).columns == ["entry_id", "path", "size"]
    assert queries.oracle_sql().keys() <= entry.queries().keys()
    assert importlib.import_module("arborquery.engine")
