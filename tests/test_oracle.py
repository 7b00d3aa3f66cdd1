"""Every query with a SQL equivalent matches DuckDB on sf0.001 (row count,
column names, order-insensitive exact values) -- the driver's gate, small."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from tools.check_oracle import TABLES, digest

SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con(small_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{small_dir}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_every_sql_key_is_a_query():
    assert set(SQL) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, small_dir, con, name):
    df = E.queries()[name](spark, small_dir)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(SQL[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert len(rows) == len(orows)
    assert sorted(df.columns) == sorted(ocols)
    assert digest(df.columns, rows, 0) == digest(ocols, orows, 0)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert len([c for c in df.columns if c.startswith(("has_bought", "never_bought"))]) == 27
