"""The queries that have SQL against DuckDB."""

import os

import duckdb
import pytest

from susceptra.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    df = queries.queries()[name](spark, sf)
    names = sorted(df.columns)
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    want = con.execute(f"select {', '.join(names)} from ({queries.oracle_sql()[name]})").fetchall()
    round6 = lambda rows: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)
    assert round6(tuple(r) for r in df.select(*names).collect()) == round6(want)
