"""Every query with SQL gives what DuckDB gives."""

import math
from pathlib import Path

import duckdb
import pytest
from pricestrata.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(x):
    if isinstance(x, float) and (math.isnan(x) or x == int(x) and abs(x) < 1e15):
        return "nan" if math.isnan(x) else int(x)
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str(tuple(plain(r[i]) for i in order)) for r in data)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    want = duck.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    data = want.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert data and rows(df.columns, df.collect()) == rows(columns, data)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_runs(spark, name):
    assert registry.queries()[name](spark, DATA).count() > 0
