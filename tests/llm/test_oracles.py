"""Queries that have SQL against it in DuckDB, over whole tables."""

import os

import duckdb
import pytest

from rasterloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(map(repr, (tuple(r[names.index(c)] for c in columns) for r in found.fetchall())))
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect()))) == want
