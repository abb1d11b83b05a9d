"""Every registered query that has SQL, against DuckDB on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from tessera import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: The factor panel holds every factor's own query, so of those only a few are run here.
NAMES = [n for n in catalog.oracle_sql() if not n.startswith("factor_") or n in ("factor_panel", "factor_rsi_14d", "factor_max_drawdown_20d", "factor_screening")]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "NaN" if value != value else value + 0.0
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    sql = duck.sql(catalog.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(sql.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    at = [sql.columns.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in sql.fetchall()), key=repr)
    assert got == want


def test_every_oracle_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
