"""Every query with SQL gives the rows that DuckDB gives."""

import duckdb
import pytest

from eventloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def rows(cols, data):
    return sorted(tuple(map(str, r)) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    want = duck.sql(catalog.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    exp = [tuple(r[want.columns.index(c)] for c in cols) for r in want.fetchall()]
    assert rows(cols, got) == rows(cols, exp)
