"""Every query of the relational engine against DuckDB on the same tables."""

from __future__ import annotations

import datetime
import math

import duckdb
import pytest

from quillon.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    def cell(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 4)
        return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v

    return sorted((tuple(map(cell, r)) for r in rows), key=repr)


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rel = duck.sql(ORACLE[name])
    assert sorted(rel.columns) == columns
    want = duck.sql(f"SELECT {', '.join(columns)} FROM rel").fetchall()
    assert plain(got.select(*columns).collect()) == plain(want)
