"""Portfolio queries: positions, plans, diagnostics, reviews, outcomes, weight checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.windows import ratio


def aggregate_positions(fills: DataFrame) -> DataFrame:
    """symbol, quantity: signed sums, without closed positions."""
    return fills.groupBy("symbol").agg(F.sum("quantity").cast("long").alias("quantity")).where("quantity <> 0")


def valued(positions: DataFrame, closes: DataFrame) -> DataFrame:
    """Positions with price and market value in cents; positions without a price have none."""
    return positions.join(closes, "symbol", "left").withColumn("market_value", F.round(F.col("quantity") * F.col("price"), 2))


# The limits of the portfolio warnings.
MOST_LARGEST, MOST_TOP3, LEAST_CASH, DEEP = 0.3, 0.65, 0.05, -0.1


def valuations(positions: DataFrame, bars: DataFrame, cash: float) -> DataFrame:
    """as_of_date, equity: cash and the value of what is held, on every date with bars."""
    held = bars.join(positions, "symbol").groupBy(F.col("trade_date").alias("as_of_date")).agg(F.sum(F.col("quantity") * F.col("close")).alias("value"))
    return held.select("as_of_date", F.round(F.col("value") + cash, 2).alias("equity"))


def diagnostics(values: DataFrame, cash: float, history: DataFrame) -> DataFrame:
    """Cash and position weights, concentration, drawdown of the recorded equity, and warnings; one row.

    ``values`` are positions with market_value, ``history`` is as_of_date and
    equity. Without positive equity all weights are 0.
    """
    best = F.slice(F.sort_array(F.collect_list("market_value"), asc=False), 1, 3)
    # the three largest alone: a position list never leaves its partitions whole
    top = values.where("market_value is not null").orderBy(F.desc("market_value")).limit(3).agg(best.alias("top"))
    sums = values.agg(F.coalesce(F.sum("market_value"), F.lit(0.0)).alias("pv"), F.coalesce(F.sum(F.col("market_value") * F.col("market_value")), F.lit(0.0)).alias("sq")).join(F.broadcast(top))
    by_date = Window.orderBy("as_of_date").rowsBetween(Window.unboundedPreceding, 0)  # one row a date
    path = history.withColumn("peak", F.greatest(F.lit(0.0), F.max("equity").over(by_date)))
    path = path.withColumn("dd", F.when(F.col("peak") > 0, F.col("equity") / F.col("peak") - 1).otherwise(0.0))
    falls = path.agg(F.coalesce(F.max_by("dd", "as_of_date"), F.lit(0.0)).alias("current"), F.least(F.lit(0.0), F.coalesce(F.min("dd"), F.lit(0.0))).alias("deepest"))
    equity = F.lit(cash) + F.col("pv")
    share = lambda x: F.when(equity > 0, x / equity).otherwise(0.0)
    out = sums.join(F.broadcast(falls)).select(
        equity.alias("equity"), share(F.lit(cash)).alias("cash_weight"), share(F.col("pv")).alias("gross_exposure"),
        F.coalesce(share(F.get("top", F.lit(0))), F.lit(0.0)).alias("largest_position_weight"), share(F.aggregate("top", F.lit(0.0), lambda a, x: a + x)).alias("top_three_weight"),
        F.when(equity > 0, F.col("sq") / (equity * equity)).otherwise(0.0).alias("concentration_hhi"), F.col("current").alias("current_drawdown"), F.col("deepest").alias("max_drawdown"))
    warnings = F.array_compact(F.array(
        F.when(F.col("equity") <= 0, "No positive portfolio equity is available for risk diagnostics."),
        F.when(F.col("largest_position_weight") > MOST_LARGEST, "Largest holding exceeds 30% of portfolio equity."),
        F.when(F.col("top_three_weight") > MOST_TOP3, "Top three holdings exceed 65% of portfolio equity."),
        F.when((F.col("cash_weight") < LEAST_CASH) & (F.col("equity") > 0), "Cash reserve is below 5% of portfolio equity."),
        F.when(F.col("current_drawdown") <= DEEP, "Current equity is more than 10% below its recorded peak."),
    ))
    return out.withColumn("warnings", F.array_join(warnings, " ")).drop("equity")


def trade_plan(targets: DataFrame, positions: DataFrame, closes: DataFrame, equity: float, lot: int = 100) -> DataFrame:
    """symbol, side, quantity, price: whole lots between target and current value, for targeted symbols only."""
    rows = targets.join(positions, "symbol", "left").join(closes, "symbol").where("price > 0")
    gap = F.col("weight") * equity - F.coalesce("quantity", F.lit(0)) * F.col("price")
    lots = F.floor(F.abs(gap) / F.col("price") / lot) * lot
    return rows.select("symbol", F.when(gap > 0, "buy").otherwise("sell").alias("side"), lots.cast("long").alias("quantity"), "price").where("quantity > 0")


def review(current: DataFrame, advised: DataFrame, planned: DataFrame) -> DataFrame:
    """symbol with current, advised and planned weight and what advice would change; absent counts as 0."""
    out = current.select("symbol", F.col("weight").alias("current")).join(advised.select("symbol", F.col("weight").alias("advised")), "symbol", "full_outer")
    out = out.join(planned.select("symbol", F.col("weight").alias("planned")), "symbol", "full_outer").fillna(0.0, ["current", "advised", "planned"])
    move = F.col("advised") - F.col("current")
    return out.withColumn("delta", move).withColumn("action", F.when(move > 1e-9, "increase").when(move < -1e-9, "reduce").otherwise("keep"))


def weight_problems(weights: DataFrame) -> DataFrame:
    """run_id and the first problem of its weights: not finite, out of range, sum above 1; valid runs give none."""
    bad = F.col("weight").isNull() | F.isnan("weight")
    out = weights.groupBy("run_id").agg(F.count_if(bad).alias("a"), F.count_if((F.col("weight") < 0) | (F.col("weight") > 1)).alias("b"), F.sum("weight").alias("s"))
    problem = F.when(F.col("a") > 0, "not_finite").when(F.col("b") > 0, "out_of_range").when(F.col("s") > 1 + 1e-9, "sum_above_one")
    return out.select("run_id", problem.alias("problem")).where("problem is not null")


def predictions_to_weights(scores: DataFrame, top_n: int, cap: float, gross: float) -> DataFrame:
    """trade_date, symbol, weight: positive scores, first of repeated rows, the best ``top_n`` in proportion, capped by min(cap, gross / n)."""
    once = scores.where("score > 0").groupBy("trade_date", "symbol").agg(F.max("score").alias("score"))
    w = Window.partitionBy("trade_date").orderBy(F.desc("score"), "symbol")
    best = once.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= top_n)
    by = Window.partitionBy("trade_date")
    share = F.col("score") / F.sum("score").over(by) * gross
    limit = F.least(F.lit(cap), F.lit(gross) / F.count(F.lit(1)).over(by))
    return best.select("trade_date", "symbol", F.least(share, limit).alias("weight"))


def outcomes(weights: DataFrame, grid: DataFrame, index: DataFrame, horizons: tuple[int, ...] = (1, 5, 20)) -> DataFrame:
    """decision_date, horizon, status, return, drawdown, excess of advice held for some dates.

    The path is the weighted price relative plus idle cash; a horizon is
    pending while a bar of any held security is missing on its path.
    """
    axis = index.select("trade_date", F.col("close").alias("ix")).withColumn("idx", F.row_number().over(Window.orderBy("trade_date")))
    start = weights.select("decision_date").distinct().join(F.broadcast(axis.withColumnRenamed("trade_date", "decision_date")), "decision_date").select("decision_date", F.col("idx").alias("i0"), F.col("ix").alias("x0"))
    path = start.withColumn("idx", F.explode(F.sequence(F.col("i0"), F.col("i0") + max(horizons)))).join(F.broadcast(axis), "idx").withColumn("step", F.col("idx") - F.col("i0"))
    price = grid.select("symbol", "trade_date", "close")
    held = weights.join(path, "decision_date").join(price, ["symbol", "trade_date"], "left")
    base = weights.join(price.withColumnRenamed("trade_date", "decision_date"), ["symbol", "decision_date"], "left").select("decision_date", "symbol", F.col("close").alias("c0"))
    each = held.join(base, ["decision_date", "symbol"])
    daily = each.groupBy("decision_date", "step").agg(
        (F.sum(F.col("weight") * ratio(F.col("close"), F.col("c0"))) + 1 - F.sum("weight")).alias("v"), F.count_if(F.col("close").isNull() | F.col("c0").isNull()).alias("gone"), F.first(F.col("ix") / F.col("x0")).alias("b"))
    w = Window.partitionBy("decision_date").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    run = daily.withColumns({"peak": F.max("v").over(w), "missing": F.sum("gone").over(w)}).withColumn("worst", F.min(ratio(F.col("v"), F.col("peak")) - 1).over(w))
    ends = run.where(F.col("step").isin(*horizons))
    done = F.col("missing") == 0
    return ends.select("decision_date", F.col("step").alias("horizon"), F.when(done, "done").otherwise("pending").alias("status"),
                       F.when(done, F.col("v") - 1).alias("return"), F.when(done, F.col("worst")).alias("drawdown"), F.when(done, F.col("v") - F.col("b")).alias("excess"))


def expired(advice: DataFrame, bars: DataFrame, calendar: DataFrame, days: int = 14) -> DataFrame:
    """advice_id and whether the advice can no longer be carried out at its time.

    Its day is the first trading day within ``days`` after its date; it has
    expired once every one of its symbols has a bar after that day. A symbol
    without any bar, or no trading day in reach, keeps it open. ``calendar``
    holds trade_date and, where closed days are in it, is_open.
    """
    last = bars.groupBy("symbol").agg(F.max("trade_date").alias("last"))
    open_days = (calendar.where("is_open") if "is_open" in calendar.columns else calendar).select("trade_date").distinct()
    # a trading day is the first within reach for the dates of the ``days`` before it, so the dates meet it by equality
    reach = open_days.select("trade_date", F.explode(F.sequence(F.date_sub("trade_date", days), F.date_sub("trade_date", 1))).alias("as_of"))
    first = advice.select("as_of").distinct().join(reach, "as_of").groupBy("as_of").agg(F.min("trade_date").alias("day"))
    known = advice.join(last, "symbol", "left").groupBy("advice_id", "as_of").agg(F.min("last").alias("earliest"), F.count_if(F.col("last").isNull()).alias("unknown"))
    return known.join(first, "as_of", "left").select("advice_id", F.coalesce((F.col("unknown") == 0) & (F.col("earliest") > F.col("day")), F.lit(False)).alias("expired"))


def best_candidates(runs: DataFrame, top: int = 100) -> DataFrame:
    """Runs by annual * 100 + sharpe * 10 - |drawdown| * 40 + stressed sharpe * 5."""
    score = F.col("annual_return") * 100 + F.col("sharpe") * 10 - F.abs("max_drawdown") * 40 + F.col("stressed_sharpe") * 5
    return runs.withColumn("score", score).orderBy(F.desc("score"), "run_id").limit(top)


# Trading days that a validation needs out of sample.
LEAST_DAYS = 126


def eligibility(runs: DataFrame, least_windows: int = 3) -> DataFrame:
    """status and flags of validated runs.

    ``runs`` holds run_id, pit_source (built from a point-in-time universe),
    n_dates (trading dates of the recorded range), benchmark_complete,
    n_windows and oos_days. Point-in-time faults come first, then the
    benchmark, then too little history.
    """
    pit = F.when(~F.col("pit_source"), "source backtest was not built from a point-in-time research universe")
    calendar = F.when(F.col("pit_source") & (F.col("n_dates") == 0), "local trading calendar has no dates for the recorded backtest range")
    benchmark = F.when(~F.col("benchmark_complete"), "local benchmark does not cover every OOS window boundary")
    windows = F.when(F.col("n_windows") < least_windows, "fewer than the requested number of independent OOS windows were available")
    days = F.when(F.col("oos_days") < LEAST_DAYS, f"fewer than {LEAST_DAYS} OOS trading days were available")
    status = (
        F.when(pit.isNotNull() | calendar.isNotNull(), "not_eligible_pit_degraded").when(benchmark.isNotNull(), "not_eligible_benchmark_missing")
        .when(windows.isNotNull() | days.isNotNull(), "not_eligible_insufficient_oos_history").otherwise("eligible")
    )
    return runs.withColumns({"status": status, "flags": F.array_join(F.array_compact(F.array(pit, calendar, benchmark, windows, days)), "; ")})


def compare_variants(metrics: DataFrame, base: str, other: str, names: tuple[str, ...]) -> DataFrame:
    """metric, base, other, delta of two runs."""
    long = metrics.where(F.col("run_id").isin(base, other)).select("run_id", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("v")) for n in names])).alias("m"))
    return long.groupBy(F.col("m.metric").alias("metric")).agg(F.max(F.when(F.col("run_id") == base, F.col("m.v"))).alias("base"), F.max(F.when(F.col("run_id") == other, F.col("m.v"))).alias("other")).withColumn("delta", F.col("other") - F.col("base"))


# The metrics that windows are averaged over, and the ranges of believable candidates.
WINDOW_METRICS = ("total_return", "annual_return", "max_drawdown", "sharpe", "benchmark_return", "excess_return")
BELIEVED = {"annual_return": (-1, 5), "sharpe": (-10, 10), "max_drawdown": (-1, 0), "stressed_sharpe": (-10, 10)}


def window_metric_means(windows: DataFrame, key: str = "validation_id") -> DataFrame:
    """Means of the six metrics over the windows of a validation, a missing metric counting as 0."""
    return windows.groupBy(key).agg(*(F.round(F.avg(F.coalesce(m, F.lit(0.0))), 6).alias(m) for m in WINDOW_METRICS))


def proven(validations: DataFrame, runs: DataFrame, provenance: DataFrame) -> DataFrame:
    """Completed, eligible validations that their run and its provenance confirm.

    ``validations`` holds validation_id, run_id, status, eligibility_status,
    source_fingerprint and what its specification says: spec_strategy,
    spec_run_id, spec_fingerprint, as_of_date (end of the last window; null
    where there is none). ``runs`` is run_id, strategy_name; ``provenance`` is
    run_id, fingerprint. Nulls confirm nothing.
    """
    good = validations.where("status = 'completed' and eligibility_status = 'eligible' and as_of_date is not null")
    joined = good.join(runs.select("run_id", "strategy_name"), "run_id").join(provenance.select("run_id", F.col("fingerprint").alias("_p")), "run_id")
    return joined.where("spec_strategy = strategy_name and spec_run_id = run_id and spec_fingerprint = _p and source_fingerprint = _p").drop("_p")


def strategy_candidates(validations: DataFrame, runs: DataFrame, provenance: DataFrame, top: int = 100) -> DataFrame:
    """rank, validation_id, run_id, strategy_name, as_of_date, score of the best proven validations with believable metrics; the later, then the larger id, goes first among equals."""
    rows = proven(validations, runs, provenance)
    for name, (low, high) in BELIEVED.items():
        rows = rows.where(F.col(name).between(low, high))
    score = F.col("annual_return") * 100 + F.col("sharpe") * 10 - F.abs("max_drawdown") * 40 + F.col("stressed_sharpe") * 5
    order = [F.desc("score"), F.desc("as_of_date"), F.desc("validation_id")]
    best = rows.withColumn("score", F.round(score, 6)).orderBy(*order).limit(top)
    # the limit leaves ``top`` rows for the one window
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("rank", "validation_id", "run_id", "strategy_name", "as_of_date", "score")


def snapshot_matches(advice: DataFrame, validations: DataFrame, runs: DataFrame, provenance: DataFrame) -> DataFrame:
    """advice_id and whether the validation that its snapshot names still stands and says the same.

    ``advice`` holds advice_id, strategy_name, as_of_date and the snapshot's
    validation_id, snapshot_run_id, snapshot_fingerprint, snapshot_as_of;
    validations also hold their own fingerprint.
    """
    kept = proven(validations, runs, provenance).select(
        "validation_id", F.col("run_id").alias("_r"), F.col("spec_strategy").alias("_s"), F.col("as_of_date").alias("_d"), F.col("fingerprint").alias("_f"))
    same = (F.col("_s") == F.col("strategy_name")) & (F.col("_d") == F.col("as_of_date")) & (F.col("snapshot_run_id") == F.col("_r")) & (F.col("snapshot_fingerprint") == F.col("_f")) & (F.col("snapshot_as_of") == F.col("_d"))
    return advice.join(kept, "validation_id", "left").select("advice_id", F.coalesce(same, F.lit(False)).alias("matches"))


def variant_winner(runs: DataFrame, base: str, other: str) -> DataFrame:
    """One row: who wins by drawdown, then excess return, then Sharpe ratio; the first difference that isn't 0 decides, missing metrics count as 0."""
    names = ("max_drawdown", "excess_return", "sharpe")
    value = lambda m, r: F.coalesce(F.max(F.when(F.col("run_id") == r, F.col(m))), F.lit(0.0))
    deltas = runs.where(F.col("run_id").isin(base, other)).agg(*((value(m, other) - value(m, base)).alias(f"{m}_delta") for m in names))
    winner = F.lit("tie")
    for m in reversed(names):
        winner = F.when(F.col(f"{m}_delta") > 0, "other").when(F.col(f"{m}_delta") < 0, "base").otherwise(winner)
    return deltas.withColumn("winner", winner)


def traded_by_one(traded: DataFrame, base: str, other: str, top: int = 50) -> DataFrame:
    """run_id, symbol: the first ``top`` symbols of each of two runs that the other did not trade."""
    one = traded.where(F.col("run_id").isin(base, other)).groupBy("symbol").agg(F.min("run_id").alias("run_id"), F.max("run_id").alias("_m")).where("run_id = _m")
    w = Window.partitionBy("run_id").orderBy("symbol")
    return one.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= top).select("run_id", "symbol")
