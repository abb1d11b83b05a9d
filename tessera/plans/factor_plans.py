"""Queries of the factor library, one per factor and one for the whole panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.factors import REGISTRY, compute
from tessera.operators.grid import dense_grid, forward_returns
from tessera.sources.tables import SQL_BARS, bars

DIGITS = 6


def rounded(name: str):
    """A rounded column without negative zeros."""
    return (F.round(name, DIGITS) + F.lit(0.0)).alias(name)


def factor_query(name: str):
    """symbol, trade_date, value of one factor on the dense grid."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        panel = compute(dense_grid(bars(spark, sf_dir)), [name])
        return panel.select("symbol", "trade_date", (F.round(name, DIGITS) + F.lit(0.0)).alias("value"))

    return query


def factor_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All factors: every symbol and date of the grid."""
    panel = compute(dense_grid(bars(spark, sf_dir)))
    return panel.select("symbol", "trade_date", *map(rounded, REGISTRY))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward returns of the default horizons."""
    out = forward_returns(dense_grid(bars(spark, sf_dir)))
    return out.select("symbol", "trade_date", *(rounded(f"fwd_{h}d") for h in (1, 5, 10, 20)))


QUERIES = {f"factor_{n}": factor_query(n) for n in REGISTRY} | {"factor_panel": factor_panel, "forward_returns": labels}

# ---- DuckDB

SQL_GRID = f"""{SQL_BARS}, grid AS (
  SELECT s.symbol, d.trade_date, b.open, b.high, b.low, b.close, b.volume, b.amount
  FROM (SELECT DISTINCT symbol FROM bars) s CROSS JOIN (SELECT DISTINCT trade_date FROM bars) d
  LEFT JOIN bars b ON b.symbol = s.symbol AND b.trade_date = d.trade_date)"""
SQL_BASE = f"""{SQL_GRID}, b1 AS (
  SELECT *, lag(close) OVER w AS prev, CAST(row_number() OVER w AS DOUBLE) AS i,
    ln(CASE WHEN amount > 0 THEN amount END) AS la, ln(CASE WHEN volume > 0 THEN volume END) AS lv
  FROM grid WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)
), b2 AS (
  SELECT *, close / nullif(prev, 0) - 1 AS r, close - prev AS d, la - lag(la) OVER w AS dla, lv - lag(lv) OVER w AS dlv
  FROM b1 WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)
), b3 AS (
  SELECT *, lag(r) OVER w AS r1, CASE WHEN d IS NOT NULL THEN sum(sign(d) * volume) OVER (PARTITION BY symbol ORDER BY trade_date ROWS UNBOUNDED PRECEDING) END AS obv
  FROM b2 WINDOW w AS (PARTITION BY symbol ORDER BY trade_date))"""
SQL_WINDOWS = "WINDOW w AS (PARTITION BY symbol ORDER BY trade_date), " + ", ".join(
    f"w{n} AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (5, 14, 20, 60))


def _r(agg: str, x: str, n: int) -> str:
    return f"(CASE WHEN count({x}) OVER w{n} = {n} THEN {agg}({x}) OVER w{n} END)"


def _lag(x: str, n: int) -> str:
    return f"lag({x}, {n}) OVER w"


def _div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def _corr(x: str, y: str) -> str:
    p, q = f"(CASE WHEN {y} IS NOT NULL THEN {x} END)", f"(CASE WHEN {x} IS NOT NULL THEN {y} END)"
    return f"(CASE WHEN count({p}) OVER w20 = 20 THEN covar_samp({p}, {q}) OVER w20 / nullif(stddev_samp({p}) OVER w20 * stddev_samp({q}) OVER w20, 0) END)"


def _drawdown(n: int) -> str:
    closes = f"list(close) OVER w{n}"
    return f"(CASE WHEN count(close) OVER w{n} = {n} THEN list_min(list_transform({closes}, lambda x, k: x / list_max(({closes})[1:k]) - 1)) END)"


_POSITION = _div(f"close - {_r('min', 'low', 20)}", f"{_r('max', 'high', 20)} - {_r('min', 'low', 20)}")
_TR = "(CASE WHEN prev IS NOT NULL AND high IS NOT NULL THEN greatest(high - low, abs(high - prev), abs(low - prev)) END)"
_UP, _DOWN = "(CASE WHEN d IS NOT NULL THEN greatest(d, 0) END)", "(CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END)"
_G, _L = _r("avg", _UP, 14), _r("avg", _DOWN, 14)
_VWAP = _div(_r("sum", "amount", 20), _r("sum", "volume", 20))
_FULL = "count(close) OVER w20 = 20"
_FIT = "(regr_intercept(close, i) OVER w20 + regr_slope(close, i) OVER w20 * i)"
_RATIO = "(high / nullif(low, 0))"
FACTOR_SQL = {
    **{f"momentum_{n}d": f"{_div('close', _lag('close', n))} - 1" for n in (5, 20, 60)},
    "momentum_20d_skip_5d": f"{_div(_lag('close', 5), _lag('close', 25))} - 1",
    **{f"ma_gap_{n}d": _div(f"close - {_r('avg', 'close', n)}", _r("avg", "close", n)) for n in (20, 60)},
    **{f"reversal_{n}d": f"{_div(_lag('close', n), 'close')} - 1" for n in (5, 10)},
    **{f"volatility_{n}d": _r("stddev_samp", "r", n) for n in (20, 60)},
    "downside_volatility_20d": f"sqrt({_r('avg', '(CASE WHEN r IS NOT NULL THEN pow(least(r, 0), 2) END)', 20)})",
    **{f"max_drawdown_{n}d": _drawdown(n) for n in (20, 60)},
    "atr_pct_14d": _div(_r("avg", _TR, 14), "close"),
    "intraday_range_20d": _r("avg", _div("high - low", "close"), 20),
    "log_amount_20d": f"ln({_r('avg', 'amount', 20)})",
    "amount_ratio_5d_20d": _div(_r("avg", "amount", 5), _r("avg", "amount", 20)),
    "volume_ratio_5d_20d": _div(_r("avg", "volume", 5), _r("avg", "volume", 20)),
    "amount_stability_20d": _div(_r("avg", "amount", 20), _r("stddev_samp", "amount", 20)),
    "amihud_illiquidity_20d": _r("avg", _div("abs(r)", "amount"), 20),
    "price_volume_corr_20d": _corr("r", "volume"),
    "up_day_ratio_20d": "CASE WHEN i >= 20 THEN sum(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) OVER w20 / nullif(count(r) OVER w20, 0) END",
    "money_flow_proxy_20d": _div(_r("sum", "(coalesce(sign(r), 0) * amount)", 20), _r("sum", "amount", 20)),
    "amount_volatility_20d": _r("stddev_samp", "dla", 20),
    "sharpe_20d": _div(_r("avg", "r", 20), _r("stddev_samp", "r", 20)),
    "return_skew_20d": "CASE WHEN count(r) OVER w20 = 20 THEN CASE WHEN stddev_samp(r) OVER w20 = 0 THEN 0 ELSE skewness(r) OVER w20 END END",
    "vwap_gap_20d": _div(f"close - {_VWAP}", _VWAP),
    "low_vol_reversal_20d": _div(f"{_div(_lag('close', 20), 'close')} - 1", _r("stddev_samp", "r", 20)),
    "breakout_strength_20d": f"{_div('close', _r('max', 'high', 20))} - 1",
    "drawdown_recovery_20d": f"{_div('close', _r('min', 'close', 20))} - 1",
    "close_position_20d": _POSITION,
    "price_efficiency_20d": _div(f"abs(close - {_lag('close', 20)})", _r("sum", "abs(d)", 20)),
    "intraday_momentum_20d": _r("avg", f"({_div('close', 'open')} - 1)", 20),
    "overnight_gap_20d": _r("avg", f"({_div('open', 'prev')} - 1)", 20),
    "tail_risk_20d": "CASE WHEN count(r) OVER w20 = 20 THEN quantile_cont(r, 0.05) OVER w20 END",
    "upper_shadow_20d": _r("avg", _div("high - greatest(open, close)", "high - low"), 20),
    "lower_shadow_20d": _r("avg", _div("least(open, close) - low", "high - low"), 20),
    "close_location_20d": _r("avg", _div("2 * close - high - low", "high - low"), 20),
    "rsv_20d": _POSITION,
    "amount_shock_z_20d": _div(f"amount - {_r('avg', 'amount', 20)}", _r("stddev_samp", "amount", 20)),
    "linear_slope_20d": f"CASE WHEN {_FULL} THEN regr_slope(close, i) OVER w20 / nullif(close, 0) END",
    "trend_rsquare_20d": f"CASE WHEN {_FULL} AND stddev_samp(close) OVER w20 > 0 THEN greatest(0, least(1, regr_r2(close, i) OVER w20)) END",
    "trend_residual_20d": f"CASE WHEN {_FULL} THEN (close - {_FIT}) / nullif(close, 0) END",
    "volume_return_divergence_20d": _corr("r", "dlv"),
    "price_rank_20d": f"CASE WHEN {_FULL} THEN (len(list_filter(list(close) OVER w20, lambda x: x < close)) + (len(list_filter(list(close) OVER w20, lambda x: x = close)) + 1) / 2.0 - 1) / 19 END",
    "rsi_14d": f"CASE WHEN {_L} = 0 AND {_G} > 0 THEN 100 WHEN {_L} = 0 AND {_G} = 0 THEN 50 ELSE 100 - 100 / (1 + {_div(_G, _L)}) END",
    "bollinger_zscore_20d": _div(f"close - {_r('avg', 'close', 20)}", _r("stddev_samp", "close", 20)),
    "parkinson_volatility_20d": f"sqrt({_r('avg', f'pow(ln(CASE WHEN {_RATIO} > 0 THEN {_RATIO} END), 2)', 20)} / (4 * ln(2)))",
    "return_autocorr_20d": _corr("r", "r1"),
    "obv_trend_20d": _div(f"obv - {_lag('obv', 20)}", _r("sum", "volume", 20)),
    "volatility_contraction_5d_20d": f"1 - {_div(_r('stddev_samp', 'r', 5), _r('stddev_samp', 'r', 20))}",
    "volume_weighted_return_20d": _div(_r("sum", "(r * amount)", 20), _r("sum", "amount", 20)),
    "gap_follow_through_20d": _r("avg", f"(({_div('open', 'prev')} - 1) * ({_div('close', 'open')} - 1))", 20),
}


def _one(expression: str) -> str:
    return f"WITH {SQL_BASE} SELECT symbol, trade_date, round({expression}, {DIGITS}) + 0.0 AS value FROM b3 {SQL_WINDOWS}"


ORACLE = {f"factor_{n}": _one(e) for n, e in FACTOR_SQL.items()}
ORACLE["factor_panel"] = f"WITH {SQL_BASE} SELECT symbol, trade_date, " + ", ".join(f"round({FACTOR_SQL[n]}, {DIGITS}) + 0.0 AS {n}" for n in REGISTRY) + f" FROM b3 {SQL_WINDOWS}"
ORACLE["forward_returns"] = f"WITH {SQL_GRID} SELECT symbol, trade_date, " + ", ".join(
    f"round(lead(close, {h + 1}) OVER w / nullif(lead(close, 1) OVER w, 0) - 1, {DIGITS}) + 0.0 AS fwd_{h}d" for h in (1, 5, 10, 20)
) + " FROM grid WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)"
