"""Factors by hand, against pandas, and under three invariants: truncation, future changes, other securities."""

from __future__ import annotations

import datetime as dt
import math
import re

import numpy as np
import pandas as pd
import pytest

from tessera.functions.factors import REGISTRY, compute, register
from tessera.operators.grid import dense_grid, forward_returns

SCHEMA = "symbol string, trade_date date, open double, high double, low double, close double, volume double, amount double"
DAY = dt.date(2024, 1, 1)


def walk(symbol, n, seed, gap=()):
    rng = np.random.default_rng(seed)
    price, rows = 10.0, []
    for i in range(n):
        o, price = price * (1 + rng.normal(0, 0.005)), price * (1 + rng.normal(0, 0.02))
        v = float(round(1e5 * (1 + abs(rng.normal(0, 0.3)))))
        if i not in gap:
            rows.append((symbol, DAY + dt.timedelta(i), float(o), max(o, price) * 1.01, min(o, price) * 0.99, float(price), v, v * price))
    return rows


def panel(spark, rows, names=None):
    pdf = compute(dense_grid(spark.createDataFrame(rows, SCHEMA)), names).toPandas()
    return pdf.sort_values(["symbol", "trade_date"]).set_index(["symbol", "trade_date"])


@pytest.fixture(scope="module")
def rows():
    return walk("000001", 80, 1, gap=(40,)) + walk("000002", 80, 2)


@pytest.fixture(scope="module")
def full(spark, rows):
    return panel(spark, rows)


def test_registry():
    assert len(REGISTRY) == 53 and {f.direction for f in REGISTRY.values()} == {1, -1}
    with pytest.raises(ValueError):
        register("rsi_14d", 1, "x", lambda: None)
    with pytest.raises(KeyError):
        compute(None, ["no_such"])


def test_truncation_and_future(spark, rows, full):
    cut = DAY + dt.timedelta(65)
    early = panel(spark, [r for r in rows if r[1] <= cut])
    changed = panel(spark, [r if r[1] <= cut else (*r[:2], *(x * 3 for x in r[2:])) for r in rows])
    want = full[full.index.get_level_values(1) <= cut]
    for other in (early, changed[changed.index.get_level_values(1) <= cut]):
        pd.testing.assert_frame_equal(other.astype(float), want.astype(float), rtol=1e-9, atol=1e-12)


def test_other_securities_do_not_matter(spark, rows, full):
    alone = panel(spark, [r for r in rows if r[0] == "000002"])
    pd.testing.assert_frame_equal(alone.astype(float), full.loc[["000002"]].astype(float), rtol=1e-9, atol=1e-12)


def test_against_pandas(rows, full):
    b = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
    c, v, a, h, l = (b.pivot(index="trade_date", columns="symbol", values=x) for x in ("close", "volume", "amount", "high", "low"))
    r = c.pct_change(fill_method=None)
    expected = {
        "momentum_20d": c / c.shift(20) - 1, "volatility_20d": r.rolling(20).std(), "return_skew_20d": r.rolling(20).skew(), "tail_risk_20d": r.rolling(20).quantile(0.05),
        "price_volume_corr_20d": r.rolling(20).corr(v), "max_drawdown_20d": c.rolling(20).apply(lambda x: (x / np.maximum.accumulate(x) - 1).min(), raw=True),
        "amihud_illiquidity_20d": (r.abs() / a).rolling(20).mean(), "parkinson_volatility_20d": np.sqrt((np.log(h / l) ** 2).rolling(20).mean() / (4 * math.log(2))),
        "price_rank_20d": c.rolling(20).apply(lambda x: (pd.Series(x).rank().iloc[-1] - 1) / 19, raw=True), "return_autocorr_20d": r.rolling(20).corr(r.shift(1)),
    }
    for name, want in expected.items():
        got = full[name].astype(float).unstack(0)
        got.index = pd.Index(got.index)
        np.testing.assert_allclose(got.to_numpy(), want.to_numpy(), rtol=1e-7, atol=1e-10, err_msg=name)


def test_hand_values(spark):
    flat = [("000001", DAY + dt.timedelta(i), 10.0, 10.0, 10.0, 10.0, 0.0, 0.0) for i in range(30)]
    last = panel(spark, flat).iloc[-1]
    assert last["momentum_20d"] == 0 and last["rsi_14d"] == 50 and last["return_skew_20d"] == 0 and last["price_rank_20d"] == 0.5
    assert all(pd.isna(last[n]) for n in ("sharpe_20d", "amount_stability_20d", "vwap_gap_20d", "log_amount_20d", "trend_rsquare_20d", "close_position_20d"))


def test_label_enters_the_next_day(spark):
    rows = [("000001", DAY + dt.timedelta(i), p, p, p, p, 1.0, p) for i, p in enumerate((10.0, 20.0, 30.0, 60.0))]
    first = forward_returns(dense_grid(spark.createDataFrame(rows, SCHEMA)), (1, 2)).orderBy("trade_date").first()
    assert first.fwd_1d == 0.5 and first.fwd_2d == 2.0


def test_frames_go_on_from_batch_to_batch(spark, rows, full):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        small = panel(spark, rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    pd.testing.assert_frame_equal(small, full, check_exact=True)


def test_no_window_runs_through_its_frame_for_each_row(spark, rows):
    plan = compute(dense_grid(spark.createDataFrame(rows, SCHEMA)))._jdf.queryExecution().optimizedPlan().toString()
    frames = set(re.findall(r"windowframe\(RowFrame, (\S+), (\S+?)\)", plan))
    assert "windowframe(RowFrame" in plan and all(low == high or low.startswith("unbounded") for low, high in frames)
