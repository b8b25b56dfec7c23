import os

import duckdb
import pytest

import __spark_entry__ as entry
from susceptra.plans import catalogue, columns, domain, fitting, placing, stateful, udtfs  # noqa: F401


def rounded(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else str(x) if not isinstance(x, (int, float, type(None))) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_matches_sql(spark, sf_dir, name):
    df = catalogue.queries()[name](spark, sf_dir)
    names = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*[f"`{c}`" for c in names]).collect()]
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    cur = con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in names)} from ({sql})")
    expected = cur.fetchall()
    got, want = rounded(rows), rounded(expected)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) < 1e-6) for x, y in zip(a, b, strict=True)), (a, b)


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
