"""Every corpus query with SQL gives the rows that DuckDB gives."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import __spark_entry__  # noqa: E402
from eventloom.llm import queries  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = __spark_entry__.queries()[name](spark, SF)
    want = con.sql(queries.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    key = lambda r: tuple(map(str, r))
    got = sorted(key(r[c] for c in cols) for r in df.collect())
    assert got == sorted(key(r[want.columns.index(c)] for c in cols) for r in want.fetchall())
