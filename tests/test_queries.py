"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import math
from datetime import date, datetime

import duckdb
import pytest

import __spark_entry__ as entry
from keepwise.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float) and math.isfinite(value):
        return f"{value:.6f}"
    if isinstance(value, (date, datetime)):
        return value.isoformat()[:10]
    return str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(row[i]) for i in order) for row in rows)


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 3


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    sql = entry.oracle_sql().get(name)
    if sql:
        found = duck.execute(sql)
        assert table(df.columns, rows) == table([d[0] for d in found.description], found.fetchall())
