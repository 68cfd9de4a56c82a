"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from helixframe import plans
from helixframe.plans.registry import TABLES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, bool):
        return str(x)
    return f"{x:.9g}" if isinstance(x, (int, float)) and abs(x) < 1e9 else str(x)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, DATA)
    got = table(df.columns, df.collect())
    if name in plans.ORACLES:
        found = duck.execute(plans.ORACLES[name])
        assert got == table([c[0] for c in found.description], found.fetchall())


def test_each_check_has_a_query():
    assert set(plans.ORACLES) <= set(plans.QUERIES)
