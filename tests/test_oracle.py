"""Every registered query against its DuckDB oracle at sf0.001 (the driver
runs the same comparison at sf0.01)."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from marketlens.plans import registry
from tests.conftest import SF001

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
QUERIES = registry.queries()
SQL = registry.oracle_sql()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if v is not None and type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return v


def _canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


def test_every_query_registered_with_oracle():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(E.queries()) and set(SQL) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF001)
    rows, cols = [tuple(r) for r in df.collect()], df.columns
    cur = con.execute(SQL[name])
    drows, dcols = cur.fetchall(), [d[0] for d in cur.description]
    assert sorted(cols) == sorted(dcols)
    assert _canon(rows, cols) == _canon(drows, dcols)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "total_orders" in df.columns
