"""Market regime: trend, breadth, volatility and an ordered classification."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.windows import by_symbol, lag, ratio, trailing


def sigmoid(x: Column) -> Column:
    """Logistic function."""
    return 1.0 / (1.0 + F.exp(-x))


def index_metrics(index: DataFrame) -> DataFrame:
    """Per date of one series, from its rows up to that date: trend, breadth and volatility scores in 0..1 and the drawdown.

    trend is the mean of four sigmoids: close over its 20-row average (by 5 %),
    20- over 60-row and 60- over 120-row average (by 3 %), and what the 20-row
    average gained in 20 rows (by 3 %); a part without data counts 0.5.
    breadth is 0.6 of the share of the last 20 rows whose averages are in
    rising order and 0.4 of the share of rising rows. volatility is a sigmoid
    of the annualised deviation around 35 % (by 12 %).
    """
    c = F.col("close")
    full = lambda n: F.when(F.col("rn") >= n, F.avg("close").over(trailing(n)))
    rows = index.withColumns({"_r": ratio(c, lag(c)) - 1, "rn": F.row_number().over(by_symbol())}).withColumns({"ma20": full(20), "ma60": full(60), "ma120": full(120)})
    first = F.first("ma20", ignorenulls=True).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))
    base = F.when(F.col("rn") >= 40, lag(F.col("ma20"), 20)).when(F.col("rn") >= 21, first)
    part = lambda x, y, by: F.coalesce(sigmoid((x - y) / F.when(y > 0, y) / by), F.lit(0.5))
    trend = (part(c, F.col("ma20"), 0.05) + part(F.col("ma20"), F.col("ma60"), 0.03) + part(F.col("ma60"), F.col("ma120"), 0.03) + part(F.col("ma20"), base, 0.03)) / 4
    rising = F.when((F.col("ma20") > F.col("ma60")) & (F.col("ma60") > F.col("ma120")), 1.0).otherwise(0.0)
    rows = rows.withColumns({"trend_score": trend, "_order": rising, "_up": F.when(F.col("_r") > 0, 1.0).otherwise(0.0)})
    deviation = F.stddev_samp("_r").over(trailing(20))
    calm = deviation.isNull() | (deviation <= 0)
    peak = F.when(F.col("rn") >= 120, F.max("close").over(trailing(120)))
    rows = rows.withColumns({
        "breadth_score": 0.6 * F.avg("_order").over(trailing(20)) + 0.4 * F.avg("_up").over(trailing(19)),
        "volatility_score": F.when(calm, 0.0).otherwise(sigmoid((deviation * 252**0.5 - 0.35) / 0.12)),
        "drawdown": F.when(peak > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (peak - c) / peak))).otherwise(0.0),
    })
    return rows.drop("_r", "_order", "_up")


# The regimes in their order, each with its condition and its confidence (base, weights, least, most).
RULES = [
    ("PANIC", "v >= 0.70 AND d >= 0.15 AND t <= 0.40", "0.6 + 0.4 * ((v - 0.7) / 0.3 + (d - 0.15) / 0.5) / 2", 0.6, 0.95),
    ("PANIC", "d >= 0.35", "0.6 + d", 0.6, 0.95),
    ("EUPHORIA", "t >= 0.65 AND v >= 0.55 AND d <= 0.10", "0.5 + 0.4 * t + 0.3 * v", 0.55, 0.90),
    ("BULL", "t >= 0.55 AND b >= 0.40 AND v <= 0.60 AND d <= 0.15", "0.4 + 0.4 * t + 0.2 * b", 0.50, 0.90),
    ("BULL", "t >= 0.50 AND b >= 0.60", "0.4 + 0.4 * b + 0.2 * t", 0.45, 0.85),
    ("BEAR", "t <= 0.35 AND b <= 0.30", "0.5 + 0.3 * (0.5 - t) + 0.2 * (0.5 - b) + 0.2 * d", 0.50, 0.90),
    ("BEAR", "d >= 0.20 AND t <= 0.40", "0.5 + 0.3 * d + 0.2 * (0.5 - t)", 0.50, 0.85),
    ("BEAR", "t <= 0.25", "0.6 + 0.4 * (0.5 - t)", 0.55, 0.90),
    ("SIDEWAYS", "true", "1.0 - (abs(t - 0.5) * 2 + abs(b - 0.5) + abs(v - 0.4)) / 3", 0.30, 0.75),
]
LEAST_ROWS, FULL_ROWS = 20, 120
# What each rule is called, in the order of RULES.
RULE_REASONS = (
    "恐慌信号：高波动+大幅回撤+弱势趋势", "极端回撤触发恐慌判定", "亢奋信号：强趋势+高波动+低回撤", "牛市信号：趋势向好+广度支撑", "均线多头排列", "熊市信号：弱势趋势+低广度", "回撤确认熊市", "趋势极度弱势", "震荡整理：各指标未形成明确方向")


def classify(metrics: DataFrame) -> DataFrame:
    """regime and confidence of each date: the first rule that holds.

    Below 20 rows nothing is known: SIDEWAYS without confidence and neutral
    scores. Below 120 rows the confidence shrinks in proportion.
    """
    rows = metrics.withColumns({"t": F.col("trend_score"), "b": F.col("breadth_score"), "v": F.col("volatility_score"), "d": F.col("drawdown")})
    regime = confidence = None
    for name, rule, formula, low, high in RULES:
        value = F.greatest(F.lit(low), F.least(F.lit(high), F.expr(formula).cast("double")))
        regime = F.when(F.expr(rule), name) if regime is None else regime.when(F.expr(rule), name)
        confidence = F.when(F.expr(rule), value) if confidence is None else confidence.when(F.expr(rule), value)
    known = F.col("rn") >= LEAST_ROWS
    rows = rows.withColumns({
        "regime": F.when(known, regime).otherwise("SIDEWAYS"),
        "confidence": F.when(known, confidence * F.least(F.lit(1.0), F.col("rn") / float(FULL_ROWS))).otherwise(0.0),
        "trend_score": F.when(known, F.col("t")).otherwise(0.5),
        **{c: F.when(known, F.col(c)).otherwise(0.0) for c in ("breadth_score", "volatility_score", "drawdown")},
    })
    return rows.drop("t", "b", "v", "d")


def reasons(classified: DataFrame) -> DataFrame:
    """The rows of ``classify`` with ``reasons``: what the averages, the high, the drawdown and the volatility say, then the rule that held; below 20 rows that alone."""
    t = {"t": "trend_score", "b": "breadth_score", "v": "volatility_score", "d": "drawdown"}
    rule = None
    for (_, test, _, _, _), name in zip(RULES, RULE_REASONS, strict=True):
        held = F.expr(re.sub(r"\b([tbvd])\b", lambda m: t[m[1]], test))
        rule = F.when(held, name) if rule is None else rule.when(held, name)
    ma20, ma60, c = F.col("ma20"), F.col("ma60"), F.col("close")
    cross = F.when(ma20 > ma60, F.format_string("MA20(%.2f) > MA60(%.2f) — golden cross zone", ma20, ma60)).when(ma20 <= ma60, F.format_string("MA20(%.2f) < MA60(%.2f) — death cross zone", ma20, ma60))
    high = F.max("close").over(trailing(20))
    away = F.when(high > 0, (c - high) / high * 100).otherwise(0.0)
    told = F.array_compact(F.array(
        cross, F.when(F.col("rn") >= 20, F.format_string("距20日高点 %+.1f%%", away)), F.when(F.col("drawdown") > 0.05, F.format_string("%.1f%% 从120日高点回撤", F.col("drawdown") * 100)),
        F.when(F.col("volatility_score") > 0.6, F.format_string("高波动率 (%.2f)", "volatility_score")), rule))
    return classified.withColumn("reasons", F.when(F.col("rn") >= LEAST_ROWS, told).otherwise(F.array(F.format_string(f"Only %d bars (< {LEAST_ROWS}); insufficient for regime classification.", "rn"))))


def market_breadth(bars: DataFrame) -> DataFrame:
    """Per date: mean over securities with 60 own rows of (close > ma20 + close > ma60) / 2."""
    rows = bars.withColumns({"rn": F.row_number().over(by_symbol()), "ma20": F.avg("close").over(trailing(20)), "ma60": F.avg("close").over(trailing(60))}).where("rn >= 60")
    mark = (F.when(F.col("close") > F.col("ma20"), 1.0).otherwise(0.0) + F.when(F.col("close") > F.col("ma60"), 1.0).otherwise(0.0)) / 2
    return rows.groupBy("trade_date").agg(F.avg(mark).alias("breadth"), F.count(F.lit(1)).alias("n"))
