"""Queries over whole tables, against loops over all rows."""

from __future__ import annotations

import duckdb
import pytest

from tessera import catalog
from tessera.plans import repository_plans

from .test_oracle import SF, TABLES

@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_positions_by_a_loop(spark, duck):
    want = {}
    for supplier, flag, quantity in duck.sql("SELECT l_suppkey, l_returnflag, l_quantity FROM lineitem").fetchall():
        symbol = str(supplier).zfill(6)
        want[symbol] = want.get(symbol, 0) + int(quantity) * (-1 if flag == "R" else 1)
    got = dict(map(tuple, catalog.queries()["positions"](spark, SF).collect()))
    assert got == {k: v for k, v in want.items() if v}


def test_the_job_log_has_every_order(spark, duck):
    want = {r[0] for r in duck.sql("SELECT o_orderkey FROM orders").fetchall()}
    assert {r.job_id for r in repository_plans.jobs(spark, SF).collect()} == want
