"""Every query with SQL gives what DuckDB gives on the same tables."""

import pytest
from compare import plain, rows_of

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def test_names():
    assert set(SQL) <= set(QUERIES)
    assert {f"p{n}_found" for n in (1, 2, 4, 5, 6)} <= set(QUERIES)


@pytest.fixture(scope="module")
def duck(sf):
    from pathlib import Path

    import duckdb

    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cur = duck.execute(SQL[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cur.fetchall())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0 and plain(1.0) == 1.0
