"""Queries over tables that are a few times the smallest ones, against DuckDB."""

from __future__ import annotations

import duckdb
import pytest

from tessera import catalog

from .test_oracle import SF, TABLES, plain

TIMES = 40
#: Keys that are shifted in each repetition, and by how much.
SHIFTED = {"supplier": {"s_suppkey": 100}, "customer": {"c_custkey": 10_000}, "orders": {"o_orderkey": 100_000, "o_custkey": 10_000}, "lineitem": {"l_orderkey": 100_000, "l_suppkey": 100}}


@pytest.fixture(scope="module")
def larger(tmp_path_factory):
    """The smallest tables, some repeated TIMES times with shifted keys; and DuckDB over them."""
    folder, con = tmp_path_factory.mktemp("larger"), duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        keys = ", ".join(f"CAST({k} + i * {by} AS BIGINT) AS {k}" for k, by in SHIFTED.get(t, {}).items())
        rows = f"SELECT f.* REPLACE ({keys}) FROM range({TIMES}) r(i), '{SF}/{t}.parquet' f" if keys else f"SELECT * FROM '{SF}/{t}.parquet'"
        con.sql(f"COPY ({rows}) TO '{folder}/{t}.parquet'")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["portfolio_snapshot"])
def test_query_equals_sql(spark, larger, name):
    folder, con = larger
    df, sql = catalog.queries()[name](spark, folder), con.sql(catalog.oracle_sql()[name])
    columns = sorted(df.columns)
    at = [sql.columns.index(c) for c in columns]
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    want = sorted((tuple(plain(r[i]) for i in at) for r in sql.fetchall()), key=repr)
    assert got == want and got


def test_next_symbols_heed_every_job(spark, larger):
    folder, con = larger
    done = {c % 400 + 1 for c, s in con.sql("SELECT o_custkey, o_orderstatus FROM orders").fetchall() if s in ("F", "P")}
    fit = [k for k, nation in con.sql("SELECT s_suppkey, s_nationkey FROM supplier").fetchall() if nation % 3 < 2 and k % 29 and k % 17 and k % 23]
    want = [str(k).zfill(6) for k in sorted(set(fit) - done)[:10]]
    assert [r.symbol for r in catalog.queries()["next_incomplete_symbols"](spark, folder).collect()] == want and want
