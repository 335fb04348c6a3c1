"""Every query with an SQL twin gives the same rows as DuckDB."""

import decimal

import duckdb
import pytest

from lodestone.plans import catalog
from lodestone.sources.standin import BASE

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in BASE:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return f"D{v}" if isinstance(v, decimal.Decimal) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    df = QUERIES[name](spark, DATA)
    r = con.execute(SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(plain(row[names.index(c)]) for c in df.columns) for row in r.fetchall())
    assert sorted(tuple(map(plain, row)) for row in df.collect()) == want


def test_no_python_in_reports(spark):
    for name in ("sales_summary", "resource_performance", "eav_pivot", "search_rank"):
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
