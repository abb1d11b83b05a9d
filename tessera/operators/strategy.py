"""Ranking strategies as declarative plans: features, gates, scores, ranks, weights.

A strategy reads each security's own rows (no dense grid). Its features are
trailing windows over those rows, all in one window stage. A decision date
sees every security's latest row at or before it, however stale.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql.window import WindowSpec
from pyspark.sql import functions as F

from tessera.functions.windows import average_rank, by_symbol, lag, ratio, trailing


@dataclass(frozen=True)
class Strategy:
    """gate: SQL condition on features; factors: feature -> (weight, sign), scored by percentile.

    Without factors ``order`` ranks the candidates (an expression, best first
    when descending). ``buffered`` strategies look at what is held when they
    select: a held name stays while its rank is within hold * top_n, a new one
    enters within entry * top_n. ``relative`` names a feature that is low in
    good candidates, its weight and its limit: candidates above the limit go,
    those without a value get no points, and where nobody has one the factors'
    own weights hold. A date on which the condition ``silent`` holds has no
    candidates.
    """

    name: str
    gate: str
    factors: dict[str, tuple[float, int]] = field(default_factory=dict)
    order: str = "score"
    ascending: bool = False
    then: str | None = None
    top_n: int = 10
    cap: float = 0.1
    gross: float = 0.95
    hold: float = 1.0
    entry: float | None = 1.0
    buffered: bool = False
    weighting: str = "equal"
    relative: tuple[str, float, float] | None = None
    silent: str = "false"

    def with_params(self, **changes) -> Strategy:
        """The same strategy with other parameters; exposures must lie in 0..1 and buffers at 1 or above."""
        out = replace(self, **changes)
        if not (0 <= out.cap <= 1 and 0 <= out.gross <= 1 and out.top_n >= 1 and out.hold >= 1 and (out.entry is None or out.entry >= 1)):
            raise ValueError(f"parameters out of range: {changes}")
        return out


#: Rows over which the benchmark's momentum is taken, and the momentum above which the inverse strategy stands aside.
INDEX_WINDOW, MOST_INDEX_MOMENTUM = 20, 1.0
#: What the other factors weigh where a relative one exists: trend the rest, calm and volume these.
RELATIVE_SHARES = {"vol19": 0.25, "volx": 0.15}


def catalogue(least_amount: float = 5e7, least_price: float = 5.0, calm_drawdown: float = 0.25, inverse_drawdown: float = 0.5, up_ratio: float = 0.5,
              oversold: float = -0.05, oversold_rsi: float = 30.0, oversold_z: float = 1.5, most_index_momentum: float = MOST_INDEX_MOMENTUM) -> dict[str, Strategy]:
    """The built-in strategies with their defaults."""
    liquid = f"amt20 >= {least_amount} AND close >= {least_price}"
    calm = "amt5 <= 2.5 * amt20 AND amt20 > 0"
    found = [
        Strategy("moving_average", "rn >= 60 AND ma20 > ma60", order="symbol", ascending=True, top_n=10**9, weighting="full", cap=0.95),
        Strategy("momentum_rank", f"rn > 65 AND amt20 >= {least_amount} AND mom60s5 > 0", order="mom60s5", cap=0.1, gross=0.8),
        Strategy("mean_reversion", "rn >= 20 AND z20 <= -1.5", order="z20", ascending=True, top_n=5, cap=1.0),
        Strategy("risk_adjusted_momentum", f"rn >= 61 AND close > ma60 AND sharpe20 >= 0 AND {liquid}", order="sharpe20", cap=0.15),
        Strategy("volatility_contraction_breakout", f"rn >= 61 AND close > ma60 AND near20 >= 0.95 AND volx >= 1 AND atr14 > 0 AND atr_rank <= 0.5 AND {liquid}",
                 {"trend60": (0.25, 1), "near20": (0.25, 1), "volx": (0.25, 1), "atr_rank": (0.25, -1)}, cap=0.15),
        Strategy("trend_filtered_mean_reversion", f"rn >= 121 AND close > ma120 AND ret5 <= {oversold} AND (rsi14 <= {oversold_rsi} OR z20 <= {-oversold_z}) AND {liquid}",
                 {"ret5": (1 / 3, -1), "rsi14": (1 / 3, -1), "z20": (1 / 3, -1)}),
        Strategy("low_vol_defensive", f"rn >= 60 AND close > ma60 AND {liquid} AND up19 >= {up_ratio} AND dd60 >= {-calm_drawdown} AND vol19 IS NOT NULL",
                 {"trend60": (0.45, 1), "vol19": (0.35, -1), "volx": (0.20, 1)}, cap=0.15, weighting="inverse_vol", relative=("beta60", 0.25, 2.0)),
        Strategy("inverse_momentum", f"rn >= 66 AND {liquid} AND {calm} AND mom60s5 <= 0 AND dd60 >= {-inverse_drawdown}", order="mom60s5", ascending=True, top_n=30, cap=0.05, gross=0.8, entry=None, buffered=True, silent=f"index_momentum > {most_index_momentum}"),
        Strategy("stable_reversal", f"rn >= 21 AND {liquid} AND {calm} AND rev5 >= 0 AND stab20 IS NOT NULL AND vola20 > 0",
                 {"stab20": (0.8 * 0.55, 1), "rev5": (0.8 * 0.45, 1), "vola20": (0.2, -1)}, then="rev5", top_n=20, cap=0.05, gross=0.8, buffered=True),
        Strategy("multi_factor_rank", f"rn >= 61 AND {liquid} AND {calm} AND vola20 > 0 AND stab20 IS NOT NULL AND lav20 IS NOT NULL AND tail20 IS NOT NULL",
                 {"lav20": (0.30, -1), "lvr20": (0.30, 1), "stab20": (0.20, 1), "mom60": (0.15, -1), "tail20": (0.05, 1)}, top_n=30, cap=0.05, gross=0.8, hold=1.3, buffered=True),
    ]
    return {s.name: s for s in found}


def _drawdown(n: int) -> Column:
    start = F.struct(F.lit(None).cast("double").alias("peak"), F.lit(None).cast("double").alias("worst"))

    def step(acc: Column, x: Column) -> Column:
        peak = F.greatest(acc["peak"], x)
        return F.struct(peak.alias("peak"), F.least(acc["worst"], x / peak - 1).alias("worst"))

    return F.aggregate(F.collect_list("close").over(trailing(n)), start, step, lambda acc: acc["worst"])


def features(bars: DataFrame) -> DataFrame:
    """Every feature of every own row. Windows may be partial; gates ask for enough rows."""
    c = F.col("close")
    rows = bars.withColumns({"rn": F.row_number().over(by_symbol()), "_prev": lag(c), "_la": F.ln(F.when(F.col("amount") > 0, F.col("amount")))})
    rows = rows.withColumns({
        "_r": ratio(c, F.col("_prev")) - 1, "_d": c - F.col("_prev"), "_dla": F.col("_la") - lag(F.col("_la")),
        "_tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("_prev")), F.abs(F.col("low") - F.col("_prev"))),
    })
    mean = lambda x, n: F.avg(x).over(trailing(n))
    gain, loss = (F.avg(F.greatest(s * F.col("_d"), F.lit(0.0))).over(trailing(14)) for s in (1, -1))
    rows = rows.withColumns({
        "ma20": mean("close", 20), "ma60": mean("close", 60), "ma120": mean("close", 120), "amt5": mean("amount", 5), "amt20": mean("amount", 20),
        "mom60s5": ratio(lag(c, 5), lag(c, 65)) - 1, "mom60": ratio(c, lag(c, 60)) - 1, "ret5": ratio(c, lag(c, 5)) - 1, "rev5": ratio(lag(c, 5), c) - 1,
        "z20": ratio(c - mean("close", 20), F.stddev_samp("close").over(trailing(20))),
        "vola20": F.stddev_samp("_r").over(trailing(20)), "sharpe20": ratio(mean("_r", 20), F.stddev_samp("_r").over(trailing(20))),
        "vol19": F.stddev_samp("_r").over(trailing(19)), "up19": mean(F.when(F.col("_r") > 0, 1.0).otherwise(0.0), 19),
        "near20": ratio(c, F.max("close").over(trailing(20))), "volx": ratio(mean("volume", 5), mean("volume", 50)),
        "stab20": ratio(mean("amount", 20), F.stddev_samp("amount").over(trailing(20))), "lav20": F.stddev_samp("_dla").over(trailing(20)),
        "tail20": F.percentile("_r", 0.05).over(trailing(20)), "dd60": _drawdown(60),
        "atr14": F.when(F.col("rn") >= 14, mean("_tr", 14)),
        "rsi14": F.when((loss == 0) & (gain > 0), 100.0).when((loss == 0) & (gain == 0), 50.0).otherwise(100 - 100 / (1 + ratio(gain, loss))),
        "_rev20": ratio(lag(c, 20), c) - 1,
    })
    recent = F.collect_list("atr14").over(trailing(20))
    return rows.withColumns({
        "trend60": ratio(c, F.col("ma60")), "lvr20": ratio(F.col("_rev20"), F.col("vola20")),
        "atr_rank": F.when(F.size(recent) >= 2, ratio(F.size(F.filter(recent, lambda x: x <= F.col("atr14"))).cast("double"), F.size(recent).cast("double"))),
    })


def with_index_momentum(decisions: DataFrame, index: DataFrame, window: int = INDEX_WINDOW) -> DataFrame:
    """Adds index_momentum of the decision date: what the index gained in ``window`` rows, 0 where it is too short."""
    before = F.lag("close", window).over(Window.orderBy("trade_date"))  # the index has one row a date
    bench = index.select(F.col("trade_date").alias("decision_date"), F.when(before > 0, F.col("close") / before - 1).alias("_k"))
    return decisions.join(F.broadcast(bench), "decision_date", "left").withColumn("index_momentum", F.coalesce("_k", F.lit(0.0))).drop("_k")


def with_beta(rows: DataFrame, index: DataFrame, window: int = 60, least: int = 5) -> DataFrame:
    """Adds beta60, the beta on the index's down days among the last common days; null below ``least`` of them or without variance."""
    w = Window.orderBy("trade_date")
    bench = index.select("trade_date", (ratio(F.col("close"), F.lag("close").over(w)) - 1).alias("_m"))
    out = rows.join(F.broadcast(bench), "trade_date", "left")
    # rows that lack either return are no common days: they are numbered away
    common = F.col("_r").isNotNull() & F.col("_m").isNotNull()
    out = out.withColumn("_n", F.count_if(common).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0)))
    near = by_symbol_of("_n").rangeBetween(-(window - 1), 0)
    down = lambda x: F.when(common & (F.col("_m") < 0), F.col(x))
    n, v, cov = F.count(down("_m")).over(near), F.var_samp(down("_m")).over(near), F.covar_samp(down("_r"), down("_m")).over(near)
    return out.withColumn("beta60", F.when((n >= least) & (v >= 1e-12), cov / v)).drop("_m", "_n")


def by_symbol_of(order: str) -> WindowSpec:
    """A security's rows in the order of a column."""
    return Window.partitionBy("symbol").orderBy(order)


def decision_rows(rows: DataFrame, dates: DataFrame, every: int) -> DataFrame:
    """decision_date and the row of every security that is its latest then.

    ``dates`` is the run's whole date axis, warm-up included; a date is a
    decision date where its index is divisible by ``every``. A row stands from
    its own index until the security's next one, so it is exploded over the
    decision indexes in between: no range join. The axis is small.
    """
    axis = dates.select("trade_date").distinct().withColumn("idx", F.row_number().over(Window.orderBy("trade_date")) - 1)
    last = axis.agg((F.max("idx") + 1).alias("n"))
    at = rows.join(F.broadcast(axis), "trade_date").join(F.broadcast(last))
    at = at.withColumn("_until", F.coalesce(F.lead("idx").over(Window.partitionBy("symbol").orderBy("idx")), F.col("n")))
    first = (F.ceil(F.col("idx") / every) * every).cast("int")
    stands = at.where(first < F.col("_until")).withColumn("didx", F.explode(F.sequence(first, (F.col("_until") - 1).cast("int"), F.lit(every))))
    when = axis.select(F.col("trade_date").alias("decision_date"), F.col("idx").alias("didx"))
    return stands.drop("idx", "n", "_until").join(F.broadcast(when), "didx").drop("didx")


def percentile(x: str, sign: int, date: str = "decision_date") -> Column:
    """(average rank - 1) / (m - 1) of sign * x; 1 for a single candidate."""
    m = F.count(F.lit(1)).over(Window.partitionBy(date))
    up = (average_rank(x, date) - 1) / (m - 1)
    return F.when(m <= 1, 1.0).otherwise(up if sign > 0 else 1 - up)


def ranked(decisions: DataFrame, strategy: Strategy) -> DataFrame:
    """decision_date, symbol, score, rank (and the volatility) of the candidates that pass the gate."""
    kept = decisions.where(strategy.gate)
    if strategy.silent != "false":
        kept = kept.where(~F.expr(strategy.silent))
    if strategy.relative:
        name, weight, limit = strategy.relative
        kept = kept.where(F.col(name).isNull() | (F.col(name) <= limit))
        by_date = Window.partitionBy("decision_date")
        n = F.count(name).over(by_date)
        place = 1 - (average_rank(name, "decision_date", "_none") - 1) / (n - 1)
        marks = {f"_p_{k}": percentile(k, sign) for k, (_, sign) in strategy.factors.items()}
        kept = kept.withColumn("_none", F.col(name).isNull()).withColumns({**marks, "_n": n, "_p": F.when(F.col(name).isNull(), 0.0).when(n <= 1, 1.0).otherwise(place)})
        rest = 1 - weight - sum(RELATIVE_SHARES.values())
        alone, beside = F.lit(0.0), F.col("_p") * weight
        for k, (w, _) in strategy.factors.items():
            alone, beside = alone + F.col(f"_p_{k}") * w, beside + F.col(f"_p_{k}") * RELATIVE_SHARES.get(k, rest)
        kept = kept.withColumn("score", F.round(F.when(F.col("_n") > 0, beside).otherwise(alone), 9))
    elif strategy.factors:
        total = sum(w for w, _ in strategy.factors.values())
        marks = {f"_p_{k}": percentile(k, sign) for k, (_, sign) in strategy.factors.items()}
        kept = kept.withColumns(marks)
        score = None
        for k, (w, _) in strategy.factors.items():
            part = F.col(f"_p_{k}") * (w / total)
            score = part if score is None else score + part
        kept = kept.withColumn("score", F.round(score, 9))
    else:
        kept = kept.withColumn("score", F.lit(0.0) if strategy.order == "symbol" else F.col(strategy.order))
    by = [F.asc("score") if strategy.ascending else F.desc("score"), *([F.desc(strategy.then)] if strategy.then else []), "symbol"]
    w = Window.partitionBy("decision_date").orderBy(*by)
    return kept.select("decision_date", "symbol", "score", F.row_number().over(w).alias("rank"), "vol19")


def target_weights(ranks: DataFrame, strategy: Strategy) -> DataFrame:
    """decision_date, symbol, weight of a strategy that doesn't look at what is held."""
    chosen = ranks.where(F.col("rank") <= strategy.top_n)
    by_date = Window.partitionBy("decision_date")
    if strategy.weighting == "full":
        return chosen.select("decision_date", "symbol", F.lit(strategy.cap).alias("weight"))
    if strategy.weighting == "inverse_vol":
        inverse = 1.0 / (F.greatest("vol19", F.lit(1e-8)) + 1e-8)
        capped = chosen.withColumn("_i", inverse).withColumn("_w", F.least(F.col("_i") / F.sum("_i").over(by_date), F.lit(strategy.cap)))
        total = F.sum("_w").over(by_date)
        return capped.select("decision_date", "symbol", F.when(total > strategy.gross, F.col("_w") * strategy.gross / total).otherwise(F.col("_w")).alias("weight"))
    n = F.count(F.lit(1)).over(by_date)
    return chosen.select("decision_date", "symbol", F.least(F.lit(strategy.cap), F.lit(strategy.gross) / n).alias("weight"))


def downside_beta(bars: DataFrame, index: DataFrame, window: int = 60, least: int = 5) -> DataFrame:
    """Per security: beta against the index over the down days among its last common days; null below ``least`` or without variance."""
    own = bars.select("symbol", "trade_date", (ratio(F.col("close"), lag(F.col("close"))) - 1).alias("r"))
    w = Window.orderBy("trade_date")
    bench = index.select("trade_date", (ratio(F.col("close"), F.lag("close").over(w)) - 1).alias("m"))
    both = own.join(F.broadcast(bench), "trade_date").dropna(subset=["r", "m"])
    recent = both.withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("trade_date")))).where((F.col("k") <= window) & (F.col("m") < 0))
    stats = recent.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.covar_samp("r", "m").alias("c"), F.var_samp("m").alias("v"))
    return stats.select("symbol", F.when((F.col("n") >= least) & (F.col("v") >= 1e-12), F.col("c") / F.col("v")).alias("beta"))


def risk_gate(weights: DataFrame, blocked: DataFrame | None = None, per_symbol: float = 0.2, total: float = 0.95, positions: int | None = None) -> DataFrame:
    """Drop blocked and negative weights, cap each, keep the largest, scale to the total (six decimals where scaled)."""
    out = weights.where("weight >= 0")
    if blocked is not None:
        out = out.join(blocked.select("decision_date", "symbol"), ["decision_date", "symbol"], "left_anti")
    out = out.withColumn("weight", F.least("weight", F.lit(per_symbol)))
    if positions is not None:
        w = Window.partitionBy("decision_date").orderBy(F.desc("weight"), "symbol")
        out = out.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= positions).drop("_k")
    s = F.sum("weight").over(Window.partitionBy("decision_date"))
    return out.withColumn("weight", F.when(s > total, F.round(F.col("weight") * total / s, 6)).otherwise(F.col("weight")))


def frictionless(weights: DataFrame, grid: DataFrame) -> DataFrame:
    """trade_date, gross_return: weights decided at one date earn from the close after it, until the next decision's weights do."""
    axis = grid.select("trade_date").distinct().withColumn("idx", F.row_number().over(Window.orderBy("trade_date")) - 1)
    decided = weights.select("decision_date").distinct().join(F.broadcast(axis.withColumnRenamed("trade_date", "decision_date")), "decision_date")
    span = decided.withColumn("until", F.lead("idx").over(Window.orderBy("idx")))
    returns = grid.select("symbol", "trade_date", (ratio(F.col("close"), lag(F.col("close"))) - 1).alias("r")).join(F.broadcast(axis), "trade_date")
    # each weight is dealt to the dates on which it earns, so that weights and returns meet on (symbol, date index)
    end = axis.agg((F.max("idx") + 1).alias("end"))
    held = weights.join(F.broadcast(span), "decision_date").join(F.broadcast(end)).withColumn("_to", F.least(F.coalesce(F.col("until") + 2, F.col("end")), F.col("end")) - 1)
    held = held.where(F.col("idx") + 2 <= F.col("_to")).select("symbol", "weight", F.explode(F.sequence(F.col("idx") + 2, F.col("_to"))).alias("idx"))
    live = held.join(returns, ["symbol", "idx"])
    return live.groupBy("trade_date").agg(F.sum(F.col("weight") * F.coalesce("r", F.lit(0.0))).alias("gross_return"))
