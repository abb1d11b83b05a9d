"""The factor library: 53 trailing-window expressions over the dense grid."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .moving import batches
from .windows import by_symbol, lag, moving, ratio, rolling, rolling_corr, rolling_skew, sharing

o, h, l, c, v, a = "open", "high", "low", "close", "volume", "amount"


@dataclass(frozen=True)
class Factor:
    """A named expression; ``direction`` is the sign that makes larger better."""

    name: str
    direction: int
    family: str
    build: Callable[[], Column]


REGISTRY: dict[str, Factor] = {}


def register(name: str, direction: int, family: str, build: Callable[[], Column]) -> None:
    """Add a factor; user code may add its own."""
    if name in REGISTRY:
        raise ValueError(f"factor {name} is registered already")
    if direction not in (1, -1):
        raise ValueError("direction is 1 or -1")
    REGISTRY[name] = Factor(name, direction, family, build)


def _c(name: str) -> Column:
    return F.col(name)


def base_columns(grid: DataFrame) -> DataFrame:
    """What several factors share, computed once: previous close, return, log changes, row number."""
    first = grid.withColumns({
        "_prev": lag(_c(c)), "_i": F.row_number().over(by_symbol()).cast("double"),
        "_la": F.ln(F.when(_c(a) > 0, _c(a))), "_lv": F.ln(F.when(_c(v) > 0, _c(v))),
    })
    second = first.withColumns({
        "_r": ratio(_c(c), _c("_prev")) - 1, "_d": _c(c) - _c("_prev"),
        "_dla": _c("_la") - lag(_c("_la")), "_dlv": _c("_lv") - lag(_c("_lv")),
    })
    signed = F.when(_c("_d").isNotNull(), F.signum("_d") * _c(v))
    return second.withColumns({"_r1": lag(_c("_r")), "_obv": F.when(signed.isNotNull(), F.sum(signed).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0)))})


def compute(grid: DataFrame, names: list[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """symbol, trade_date, the kept columns and the named factors (all by default), in one ordering by security.

    Factors share their windows and moving aggregates: each is computed once,
    lags and running sums by Spark's windows, then moving aggregates batch by
    batch over the same sorted rows, before the last projection.
    """
    names = list(REGISTRY) if names is None else names
    missing = [n for n in names if n not in REGISTRY]
    if missing:
        raise KeyError(f"unknown factors: {missing}")
    with sharing() as shared:
        built = [REGISTRY[n].build().alias(n) for n in names]
    rows = base_columns(grid).withColumns(dict(shared.windows.values()))
    if shared.moves:
        inputs = dict(shared.inputs.values())
        # the windows left the rows so; the sort is only said here
        given = rows.withColumns({name: x.cast("double") for name, x in inputs.items()}).sortWithinPartitions("symbol", "trade_date")
        schema = StructType(rows.schema.fields + [StructField(name, DoubleType()) for name in shared.moves.values()])
        rows = given.mapInArrow(batches(list(shared.moves), list(inputs), list(shared.moves.values())), schema)
    return rows.select("symbol", "trade_date", *keep, *built)


def _mean(x: Column, n: int) -> Column:
    return rolling(F.avg, x, n)


def _sum(x: Column, n: int) -> Column:
    return rolling(F.sum, x, n)


def _std(x: Column, n: int) -> Column:
    return rolling(F.stddev_samp, x, n)


def _atr(n: int) -> Column:
    true_range = F.when(_c("_prev").isNotNull() & _c(h).isNotNull(), F.greatest(_c(h) - _c(l), F.abs(_c(h) - _c("_prev")), F.abs(_c(l) - _c("_prev"))))
    return ratio(_mean(true_range, n), _c(c))


def _up_ratio(n: int) -> Column:
    up, there = F.when(_c("_r") > 0, 1.0).otherwise(0.0), F.when(_c("_r").isNotNull(), 1.0).otherwise(0.0)
    return ratio(_sum(up, n), _sum(there, n))


def _rsi(n: int) -> Column:
    gain = _mean(F.when(_c("_d").isNotNull(), F.greatest(_c("_d"), F.lit(0.0))), n)
    loss = _mean(F.when(_c("_d").isNotNull(), F.greatest(-_c("_d"), F.lit(0.0))), n)
    return F.when((loss == 0) & (gain > 0), 100.0).when((loss == 0) & (gain == 0), 50.0).otherwise(100 - 100 / (1 + ratio(gain, loss)))


def _close_position() -> Column:
    low, high = rolling(F.min, _c(l), 20), rolling(F.max, _c(h), 20)
    return ratio(_c(c) - low, high - low)


def _regression(kind: str) -> Column:
    if kind == "slope":
        return ratio(moving("slope", 20, _c("_i"), _c(c)), _c(c))
    if kind == "r2":
        return F.when(_std(_c(c), 20) > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), moving("r2", 20, _c("_i"), _c(c)))))
    slope, intercept = moving("slope", 20, _c("_i"), _c(c)), moving("intercept", 20, _c("_i"), _c(c))
    return ratio(_c(c) - (intercept + slope * _c("_i")), _c(c))


def _declare() -> None:
    def r() -> Column:
        return _c("_r")

    for n in (5, 20, 60):
        register(f"momentum_{n}d", 1, "trend", lambda n=n: ratio(_c(c), lag(_c(c), n)) - 1)
    register("momentum_20d_skip_5d", 1, "trend", lambda: ratio(lag(_c(c), 5), lag(_c(c), 25)) - 1)
    for n in (20, 60):
        register(f"ma_gap_{n}d", 1, "trend", lambda n=n: ratio(_c(c) - _mean(_c(c), n), _mean(_c(c), n)))
    for n in (5, 10):
        register(f"reversal_{n}d", 1, "reversal", lambda n=n: ratio(lag(_c(c), n), _c(c)) - 1)
    for n in (20, 60):
        register(f"volatility_{n}d", -1, "risk", lambda n=n: _std(r(), n))
    register("downside_volatility_20d", -1, "risk", lambda: F.sqrt(_mean(F.when(r().isNotNull(), F.pow(F.least(r(), F.lit(0.0)), F.lit(2))), 20)))
    for n in (20, 60):
        register(f"max_drawdown_{n}d", 1, "risk", lambda n=n: moving("drawdown", n, _c(c)))
    register("atr_pct_14d", -1, "risk", lambda: _atr(14))
    register("intraday_range_20d", -1, "risk", lambda: _mean(ratio(_c(h) - _c(l), _c(c)), 20))
    register("log_amount_20d", 1, "liquidity", lambda: F.ln(F.when(_mean(_c(a), 20) > 0, _mean(_c(a), 20))))
    register("amount_ratio_5d_20d", 1, "liquidity", lambda: ratio(_mean(_c(a), 5), _mean(_c(a), 20)))
    register("volume_ratio_5d_20d", 1, "liquidity", lambda: ratio(_mean(_c(v), 5), _mean(_c(v), 20)))
    register("amount_stability_20d", 1, "liquidity", lambda: ratio(_mean(_c(a), 20), _std(_c(a), 20)))
    register("amihud_illiquidity_20d", -1, "liquidity", lambda: _mean(ratio(F.abs(r()), _c(a)), 20))
    register("price_volume_corr_20d", 1, "volume", lambda: rolling_corr(r(), _c(v), 20))
    register("up_day_ratio_20d", 1, "volume", lambda: _up_ratio(20))
    register("money_flow_proxy_20d", 1, "volume", lambda: ratio(_sum(F.coalesce(F.signum(r()), F.lit(0.0)) * _c(a), 20), _sum(_c(a), 20)))
    register("amount_volatility_20d", -1, "liquidity", lambda: _std(_c("_dla"), 20))
    register("sharpe_20d", 1, "risk", lambda: ratio(_mean(r(), 20), _std(r(), 20)))
    register("return_skew_20d", 1, "risk", lambda: rolling_skew(r(), 20))

    def vwap_gap() -> Column:
        vwap = ratio(_sum(_c(a), 20), _sum(_c(v), 20))
        return ratio(_c(c) - vwap, vwap)

    register("vwap_gap_20d", 1, "trend", vwap_gap)
    register("low_vol_reversal_20d", 1, "reversal", lambda: ratio(ratio(lag(_c(c), 20), _c(c)) - 1, _std(r(), 20)))
    register("breakout_strength_20d", 1, "trend", lambda: ratio(_c(c), rolling(F.max, _c(h), 20)) - 1)
    register("drawdown_recovery_20d", 1, "trend", lambda: ratio(_c(c), rolling(F.min, _c(c), 20)) - 1)
    register("close_position_20d", 1, "trend", _close_position)
    register("price_efficiency_20d", 1, "trend", lambda: ratio(F.abs(_c(c) - lag(_c(c), 20)), _sum(F.abs(_c("_d")), 20)))
    register("intraday_momentum_20d", 1, "trend", lambda: _mean(ratio(_c(c), _c(o)) - 1, 20))
    register("overnight_gap_20d", 1, "trend", lambda: _mean(ratio(_c(o), _c("_prev")) - 1, 20))
    register("tail_risk_20d", 1, "risk", lambda: moving("low_tail", 20, r()))
    register("upper_shadow_20d", -1, "candle", lambda: _mean(ratio(_c(h) - F.greatest(_c(o), _c(c)), _c(h) - _c(l)), 20))
    register("lower_shadow_20d", 1, "candle", lambda: _mean(ratio(F.least(_c(o), _c(c)) - _c(l), _c(h) - _c(l)), 20))
    register("close_location_20d", 1, "candle", lambda: _mean(ratio(2 * _c(c) - _c(h) - _c(l), _c(h) - _c(l)), 20))
    register("rsv_20d", 1, "trend", _close_position)
    register("amount_shock_z_20d", -1, "liquidity", lambda: ratio(_c(a) - _mean(_c(a), 20), _std(_c(a), 20)))
    register("linear_slope_20d", 1, "trend", lambda: _regression("slope"))
    register("trend_rsquare_20d", 1, "trend", lambda: _regression("r2"))
    register("trend_residual_20d", -1, "trend", lambda: _regression("residual"))
    register("volume_return_divergence_20d", 1, "volume", lambda: rolling_corr(r(), _c("_dlv"), 20))
    register("price_rank_20d", 1, "trend", lambda: moving("place", 20, _c(c)))
    register("rsi_14d", 1, "trend", lambda: _rsi(14))
    register("bollinger_zscore_20d", 1, "trend", lambda: ratio(_c(c) - _mean(_c(c), 20), _std(_c(c), 20)))
    register("parkinson_volatility_20d", -1, "risk", lambda: F.sqrt(_mean(F.pow(F.ln(F.when(ratio(_c(h), _c(l)) > 0, ratio(_c(h), _c(l)))), F.lit(2)), 20) / (4 * math.log(2))))
    register("return_autocorr_20d", 1, "risk", lambda: rolling_corr(r(), _c("_r1"), 20))
    register("obv_trend_20d", 1, "volume", lambda: ratio(_c("_obv") - lag(_c("_obv"), 20), _sum(_c(v), 20)))
    register("volatility_contraction_5d_20d", 1, "risk", lambda: 1 - ratio(_std(r(), 5), _std(r(), 20)))
    register("volume_weighted_return_20d", 1, "volume", lambda: ratio(_sum(r() * _c(a), 20), _sum(_c(a), 20)))
    register("gap_follow_through_20d", 1, "candle", lambda: _mean((ratio(_c(o), _c("_prev")) - 1) * (ratio(_c(c), _c(o)) - 1), 20))


_declare()
