"""The operators' queries with an SQL oracle against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from factloom.llm import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from '{DATA}/{file}'")
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    cur = con.execute(catalog.oracle_sql()[name])
    at = [x[0] for x in cur.description]
    assert sorted(at) == columns
    assert got == sorted((tuple(r[at.index(c)] for c in columns) for r in cur.fetchall()), key=str)
