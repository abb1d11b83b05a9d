"""Decision rules against values worked out by hand from their limits."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluation, execution, news, pit, portfolio, regime, repository, strategy, timeline

D = dt.date


def test_screening(spark):
    rows = [
        ("good", 120, 0.02, 0.15, 0.001, 0.80), ("short", 59, 0.05, 0.5, 0.01, 0.1), ("negative", 200, -0.05, -0.6, 0.01, 0.1), ("no_ratio", 200, 0.05, None, 0.01, 0.1),
        ("few", 119, 0.05, 0.5, 0.01, 0.1), ("busy", 200, 0.05, 0.5, 0.01, 0.81), ("weak", 200, 0.0199, 0.149, 0.01, None), ("flat", 200, 0.05, 0.5, 0.0, 0.1), ("wild", 200, float("nan"), 0.5, float("inf"), 0.1),
    ]
    df = spark.createDataFrame(rows, "factor string, n_dates long, rank_ic_mean double, rank_ic_ir double, long_short_mean double, long_short_turnover double")
    got = {r.factor: (r.status, r.reasons) for r in evaluation.screen(df).collect()}
    assert got["good"] == ("candidate", ["passes the pre-OOS factor screen; rolling OOS validation is still required"])
    assert got["short"] == ("rejected", ["only 59 valid evaluation dates; need at least 60"])
    assert got["negative"] == ("rejected", ["RankIC must be finite and positive", "RankIC IR must be finite and positive"])
    assert got["no_ratio"] == ("rejected", ["RankIC IR must be finite and positive"])
    assert got["few"] == ("watch", ["only 119 dates; need 120 for candidate status"])
    assert got["busy"] == ("watch", ["long-short turnover 0.81 exceeds 0.80"])
    assert got["weak"] == ("watch", ["RankIC 0.0199 is below 0.0200", "RankIC IR 0.1490 is below 0.1500", "long-short turnover is unavailable"])
    assert got["flat"] == ("rejected", ["long-short return must be finite and positive"])
    assert got["wild"] == ("rejected", ["RankIC must be finite and positive", "long-short return must be finite and positive"])


@pytest.mark.parametrize(("sign", "days", "status", "reason"), [
    (1, 60, "stable", "all usable consecutive folds have positive RankIC and long-short return"),
    (-1, 60, "unstable", "3/3 folds have non-positive RankIC or long-short return"),
    (1, 59, "watch", "only 2/3 folds have at least 20 valid dates"),
])
def test_stability(spark, sign, days, status, reason):
    rows = [(D(2024, 1, 1) + dt.timedelta(d), f"s{k}", float(k), sign * (k + d % 3) / 100.0) for d in range(days) for k in range(6)]
    got = evaluation.stability(spark.createDataFrame(rows, "trade_date date, symbol string, x double, y double"), "x", "y", 3).orderBy("fold").collect()
    assert [r.n_dates for r in got] == [20, 20, days - 40] and {(r.status, r.reason) for r in got} == {(status, reason)}
    assert got[0].start_date == D(2024, 1, 1) and got[0].long_short_turnover == 0.0


def test_turnover_of_the_spread(spark):
    # one of two names leaves the top set and one of two the bottom set, then the bottom set loses a name
    sets = [("ab", "cd"), ("ax", "cy"), ("ax", "c")]
    rows = [("f", D(2024, 1, d + 1), s, b) for d, (low, high) in enumerate(sets) for b, names in ((1, high), (2, low)) for s in names]
    got = evaluation.spread_turnover(spark.createDataFrame(rows, "factor string, trade_date date, symbol string, bucket int"), 2, "factor").collect()
    assert got[0].long_short_turnover == pytest.approx(((0.5 + 0.0) / 2 + (0.5 + 0.5) / 2) / 2)


def test_many_factors_equal_one_at_a_time(spark):
    rng, names = random.Random(3), [f"f{k}" for k in range(evaluation.TOGETHER + 2)]
    value = lambda: rng.choice([None, 1.0, 2.0, rng.random(), rng.random(), rng.random()])
    rows = [(D(2024, 1, 1 + d), f"s{k}", value(), *(7.0 if n == "f1" else value() if d != 3 or n != "f2" else None for n in names)) for d in range(6) for k in range(70)]
    panel = spark.createDataFrame(rows, f"trade_date date, symbol string, y double, {', '.join(f'{n} double' for n in names)}").cache()
    summary = evaluation.ic_by_factor(panel, names, "y", 5)
    got = {r.factor: r for r in summary.collect()}
    assert set(got) == set(names) and got["f1"].ic_mean is None and got["f2"].n_dates == 5
    for name in ("f0", "f1", "f2", names[-1]):
        pairs = evaluation.complete_pairs(panel, name, "y", 5)
        bucketed = evaluation.with_bucket(pairs, 5)
        want = evaluation.ic_summary(evaluation.daily_ic(pairs)).first()
        spread = evaluation.long_short(bucketed, 5).agg(F.avg("long_short")).first()[0]
        turned = evaluation.spread_turnover(bucketed.withColumn("factor", F.lit(name)), 5, "factor").first()[1]
        r = got[name]
        for a, b in ((r.ic_mean, want.ic_mean), (r.rank_ic_mean, want.rank_ic_mean), (r.rank_ic_ir, want.rank_ic_ir), (r.long_short_mean, spread), (r.long_short_turnover, turned)):
            assert a == b if b is None else a == pytest.approx(b)
    # the panel is read once, and no window runs over its rows
    assert summary._jdf.queryExecution().optimizedPlan().toString().count("InMemoryRelation") == 1
    with pytest.raises(Exception, match="not dense"):
        evaluation.ic_by_factor(panel.where("trade_date < '2024-01-03' or symbol <> 's5'"), names, "y", 5).collect()


def test_regimes(spark):
    rows = [  # trend, breadth, volatility, drawdown, rows
        ("PANIC", 0.40, 0.5, 0.70, 0.15, 120, 0.6), ("PANIC", 0.9, 0.9, 0.1, 0.35, 120, 0.95), ("EUPHORIA", 0.65, 0.1, 0.55, 0.10, 120, 0.9), ("BULL", 0.55, 0.40, 0.60, 0.15, 120, 0.70),
        ("BULL", 0.50, 0.60, 0.9, 0.30, 120, 0.74), ("BEAR", 0.35, 0.30, 0.2, 0.0, 60, 0.585 / 2), ("BEAR", 0.40, 0.5, 0.2, 0.20, 120, 0.58), ("BEAR", 0.25, 0.5, 0.2, 0.0, 120, 0.70),
        ("SIDEWAYS", 0.5, 0.5, 0.4, 0.0, 120, 0.75), ("SIDEWAYS", 0.9, 0.1, 0.9, 0.5, 19, 0.0),
    ]
    df = spark.createDataFrame([(i, *r[1:6]) for i, r in enumerate(rows)], "i int, trend_score double, breadth_score double, volatility_score double, drawdown double, rn int")
    got = regime.classify(df).orderBy("i").collect()
    assert [r.regime for r in got] == [r[0] for r in rows]
    assert [r.confidence for r in got] == pytest.approx([r[6] for r in rows])
    assert (got[-1].trend_score, got[-1].volatility_score, got[-1].drawdown) == (0.5, 0.0, 0.0)


def test_index_metrics_of_a_rising_line(spark):
    closes = [100.0 * 1.01**k for k in range(130)]
    df = spark.createDataFrame([("i", D(2024, 1, 1) + dt.timedelta(k), c) for k, c in enumerate(closes)], "symbol string, trade_date date, close double")
    last = regime.classify(regime.index_metrics(df)).orderBy(F.desc("trade_date")).first()
    mean = lambda n, end=130: sum(closes[end - n : end]) / n
    s = lambda x: 1 / (1 + math.exp(-x))
    trend = (s((closes[-1] / mean(20) - 1) / 0.05) + s((mean(20) / mean(60) - 1) / 0.03) + s((mean(60) / mean(120) - 1) / 0.03) + s((mean(20) / mean(20, 110) - 1) / 0.03)) / 4
    assert last.trend_score == pytest.approx(trend) and last.drawdown == 0.0
    assert last.breadth_score == pytest.approx(0.6 * 11 / 20 + 0.4)  # the 120-row average exists for 11 rows
    assert last.volatility_score == pytest.approx(s(-0.35 / 0.12), abs=1e-4) and last.regime == "BULL"


def test_news_classes(spark):
    rows = [("公司被立案调查", "x"), ("减持计划", ""), ("减持新规发布", "破产"), ("主力净流出", ""), ("股价下跌", ""), ("ordinary", None), (None, "退市"), ("净流出", "亏损")]
    got = [tuple(r.c) for r in spark.createDataFrame(rows, "t string, b string").select(news.classify(F.col("t"), F.col("b")).alias("c")).collect()]
    none = ("neutral", "", None)
    assert got == [("severe_company_risk", "negative", -0.8), ("company_risk", "risk", -0.4), none, ("industry_market_flow", "", None), ("general_market_sentiment", "", None), none, none, ("company_risk", "risk", -0.4)]


def test_amount_bands(spark):
    rows = [(v,) for v in (99_999.0, 100_000.0, 499_999.0, 500_000.0, 1e6, 4_999_999.0, 5e6)]
    got = [r.b for r in spark.createDataFrame(rows, "v double").select(repository.amount_band(F.col("v")).alias("b")).collect()]
    assert got == ["under_100k_cny", "100k_to_500k_cny", "100k_to_500k_cny", "500k_to_1m_cny", "1m_to_5m_cny", "1m_to_5m_cny", "over_5m_cny"]


def test_eligibility(spark):
    rows = [("ok", True, 10, True, 3, 126), ("pit", False, 0, False, 0, 0), ("calendar", True, 0, True, 3, 126), ("benchmark", True, 10, False, 1, 126), ("windows", True, 10, True, 2, 126), ("days", True, 10, True, 3, 125)]
    df = spark.createDataFrame(rows, "run_id string, pit_source boolean, n_dates int, benchmark_complete boolean, n_windows int, oos_days int")
    got = {r.run_id: (r.status, r.flags) for r in portfolio.eligibility(df).collect()}
    assert {k: v[0] for k, v in got.items()} == {
        "ok": "eligible", "pit": "not_eligible_pit_degraded", "calendar": "not_eligible_pit_degraded", "benchmark": "not_eligible_benchmark_missing",
        "windows": "not_eligible_insufficient_oos_history", "days": "not_eligible_insufficient_oos_history"}
    assert got["ok"][1] == "" and got["pit"][1].count("; ") == 3 and got["days"][1] == "fewer than 126 OOS trading days were available"


def test_portfolio_diagnostics(spark):
    values = spark.createDataFrame([("a", 40.0), ("b", 30.0), ("c", 20.0), ("d", 6.0), ("e", None)], "symbol string, market_value double")
    history = spark.createDataFrame([(D(2024, 1, 1), 80.0), (D(2024, 1, 2), 120.0), (D(2024, 1, 3), 100.0)], "as_of_date date, equity double")
    r = portfolio.diagnostics(values, 4.0, history).first()
    assert (r.cash_weight, r.gross_exposure, r.largest_position_weight, r.top_three_weight) == pytest.approx((0.04, 0.96, 0.4, 0.9))
    assert (r.concentration_hhi, r.current_drawdown, r.max_drawdown) == pytest.approx((0.2936, -1 / 6, -1 / 6))
    assert r.warnings.count(".") == 4 and "Current equity is more than 10% below" in r.warnings
    none = portfolio.diagnostics(values.limit(0), 0.0, history.limit(0)).first()
    assert none.cash_weight == none.concentration_hhi == none.max_drawdown == 0.0 and none.warnings == "No positive portfolio equity is available for risk diagnostics."


def test_research_symbols(spark):
    days = [D(2024, 1, k) for k in range(1, 31)]
    stocks = spark.createDataFrame([("1", "one", "SH", "active"), ("2", "two", "BJ", "active"), ("3", "ST three", "SZ", "active")], "symbol string, name string, exchange string, status string")
    bars = spark.createDataFrame([(s, d, 1.0) for s, n in (("1", 15), ("2", 14), ("3", 30)) for d in days[:n]], "symbol string, trade_date date, close double")
    calendar = spark.createDataFrame([(d,) for d in days], "trade_date date")
    pick = lambda **k: [r.symbol for r in repository.select_research_symbols(stocks, bars, k.pop("calendar", calendar), "2024-01-01", "2024-01-30", **k).collect()]
    assert pick() == ["1"] and pick(least=14) == ["1", "2"] and pick(least=16) == [] and pick(drop_risk=False) == ["3", "1"]
    assert pick(least=14, exchanges=("SH", "SZ")) == ["1"] and pick(calendar=calendar.limit(0), least=99) == [] and pick(calendar=calendar.limit(0)) == ["1"]
    assert pick(share=0.4) == ["1", "2"] and pick(least=1, limit=0) == ["1"]


def test_the_past_does_not_know_todays_snapshot(spark):
    stocks = spark.createDataFrame([("1", "plain", "inactive"), ("2", "ST now", "active"), ("3", "gone", "inactive"), ("4", "ST now", "active")], "symbol string, name string, status string")
    old, row = D(2020, 1, 1), "symbol string, {} string, valid_from date, valid_to date, announced_at date"
    status = spark.createDataFrame([("1", "listed", old, None, None), ("2", "normal", old, None, None), ("5", "suspended", old, None, None), ("6", "st", old, D(2024, 1, 1), None)], row.format("status"))
    names = spark.createDataFrame([("2", "plain", old, None, None), ("4", "*ST then", old, D(2022, 1, 1), None)], row.format("name"))
    bars = spark.createDataFrame([(str(s), D(2023, 6, d), 1.0) for s in range(1, 7) for d in range(1, 9)], "symbol string, trade_date date, close double")
    candidates = spark.createDataFrame([(str(s),) for s in range(1, 7)], "symbol string")
    pool = lambda **k: {r.symbol: r.exclusion_reason for r in pit.universe_waterfall(candidates, stocks, status, names, bars, "2023-06-30", **k).collect()}
    assert pool() == {"1": None, "2": None, "3": "not_listed", "4": None, "5": "suspended", "6": "st"}
    assert pool(st_policy="strict")["4"] == "st" and pool(exclude_st=False)["6"] is None
    report = pit.waterfall_report(pit.universe_waterfall(candidates, stocks, status, names, bars, "2023-06-30")).first()
    assert (report.total_candidates, report.eligible_count, report.missing_status_rows, report.missing_name_rows, report.missing_st_rows, report.pit_degraded) == (6, 3, 2, 5, 5, True)


def test_availability_and_risk_are_asked_apart(spark):
    """A listed security with a risk name, an open risk row beside a later normal one, a suspension beside a risk tier, and the risk table before the mixed one."""
    stocks = spark.createDataFrame([(str(k), "plain", "active") for k in range(1, 8)], "symbol string, name string, status string")
    old, row = D(2020, 1, 1), "symbol string, {} string, valid_from date, valid_to date, announced_at date"
    status = spark.createDataFrame([
        ("1", "listed", old, None, None), ("2", "st", old, None, None), ("2", "normal", D(2022, 1, 1), None, None), ("3", "suspended", old, None, None), ("3", "st", D(2022, 1, 1), None, None),
        ("4", "listed", old, None, None), ("5", "st", old, None, None), ("6", "listed", old, None, None), ("6", "delisted", D(2023, 1, 1), None, D(2023, 7, 1)), ("7", "listed", old, None, old)], row.format("status"))
    risk = spark.createDataFrame([("4", "sst", old, None, D(2023, 8, 1)), ("5", "normal", D(2023, 1, 1), None, None), ("7", "st", old, D(2023, 6, 30), None)], row.format("st_status"))
    names = spark.createDataFrame([("1", "*ST then", old, None, None), ("5", "*ST then", old, None, None), ("7", "fine", old, None, old)], row.format("name"))
    bars = spark.createDataFrame([(str(s), D(2023, 6, d), 1.0) for s in range(1, 8) for d in range(1, 3 + s)], "symbol string, trade_date date, close double")
    candidates = stocks.select("symbol")
    build = lambda **k: pit.universe_waterfall(candidates, stocks, status, names, bars, "2023-06-30", st_status=risk, **k)
    pool = lambda **k: {r.symbol: r.exclusion_reason for r in build(**k).collect()}
    # 4's risk row, 6's delisting are announced later; 5's risk row of the date is normal, so its name is not asked; 7's risk row has ended
    assert pool(least_bars=1) == {"1": "st", "2": "st", "3": "suspended", "4": None, "5": None, "6": None, "7": None}
    assert pool(least_bars=1, exclude_st=False) == {"1": None, "2": None, "3": "suspended", **{str(k): None for k in (4, 5, 6, 7)}}
    assert pool(least_bars=8)["5"] == "no_bars" and pool(least_bars=8)["6"] is None
    calendar = spark.createDataFrame([(D(2023, 6, d), d != 30) for d in range(1, 31)], "trade_date date, is_open boolean")
    r = build(least_bars=None, least_share=0.2, start="2023-06-01", calendar=calendar, limit=2).collect()
    assert {x.symbol for x in r if x.selected} == {"6", "7"} and {(x.expected_trading_days, x.least_trading_days) for x in r} == {(29, 6)}
    assert {x.symbol: (x.missing_st, x.degraded) for x in r if x.symbol in "57"} == {"5": (False, False), "7": (True, True)}


def test_timeline_of_one_security(spark):
    row = "symbol string, {} string, valid_from date, valid_to date, announced_at date"
    status = spark.createDataFrame([("a", "listed", D(2020, 1, 1), D(2020, 6, 1), None), ("a", "st", D(2020, 2, 1), D(2020, 4, 1), D(2020, 3, 1)), ("a", "suspended", D(2020, 3, 15), D(2020, 3, 20), None),
                                    ("a", "normal", D(2020, 8, 1), D(2020, 8, 5), D(2020, 9, 1)), (None, "st", D(2020, 1, 1), None, None), ("b", "listed", D(2020, 1, 1), None, D(2020, 1, 1))], row.format("status"))
    risk = spark.createDataFrame([("a", "sst", D(2020, 3, 10), D(2020, 3, 12), None)], row.format("st_status"))
    got = [(r.symbol, str(r.valid_from)[5:], str(r.valid_to)[5:] if r.valid_to else None, r.status, r.availability, r.st_status) for r in timeline.status_timeline(status, risk).orderBy("symbol", "valid_from").collect()]
    assert got == [
        ("a", "01-01", "03-01", "listed", "listed", None), ("a", "03-01", "03-10", "st", "listed", "st"), ("a", "03-10", "03-12", "st", "listed", "sst"), ("a", "03-12", "03-15", "st", "listed", "st"),
        ("a", "03-15", "03-20", "suspended", "suspended", "st"), ("a", "03-20", "04-01", "st", "listed", "st"), ("a", "04-01", "06-01", "listed", "listed", None), ("b", "01-01", None, "listed", "listed", None)]
    asks = spark.createDataFrame([("a", D(2020, 3, 17)), ("a", D(2020, 7, 1)), ("a", D(2019, 1, 1)), ("b", D(2024, 1, 1)), ("c", D(2020, 3, 1))], "symbol string, as_of date")
    assert {(r.symbol, r.as_of.year): r.availability for r in timeline.timeline_as_of(asks.where("as_of <> '2020-07-01'"), timeline.status_timeline(status)).collect()} == {("a", 2020): "suspended", ("a", 2019): None, ("b", 2024): "listed", ("c", 2020): None}
    assert timeline.timeline_as_of(asks.where("as_of = '2020-07-01'"), timeline.status_timeline(status)).first().availability is None
    assert timeline.status_timeline(status.limit(0)).count() == 0


def test_trade_gaps_know_no_later_snapshot(spark):
    days = [D(2020, 1, d) for d in (1, 2, 3, 4)]
    grid = spark.createDataFrame([(s, d, None) for s in "abc" for d in days], "symbol string, trade_date date, close double")
    stocks = spark.createDataFrame([("a", D(2019, 1, 1), "inactive"), ("b", D(2020, 1, 3), "active")], "symbol string, list_date date, status string")
    status = spark.createDataFrame([("a", "listed", D(2019, 1, 1), None, None), ("a", "suspended", D(2020, 1, 2), D(2020, 1, 3), None), ("a", "delisted", D(2020, 1, 4), None, None)], "symbol string, status string, valid_from date, valid_to date, announced_at date")
    got = {(r.symbol, r.trade_date.day): r.gap_type for r in pit.trade_gaps(grid, stocks, status).collect()}
    assert [got["a", d] for d in (1, 2, 3, 4)] == ["provider_gap", "suspended", "provider_gap", "delisted_gap"]
    assert [got["b", d] for d in (1, 2, 3, 4)] == ["new_listing_gap"] * 2 + ["unknown"] * 2 and got["c", 1] == "unknown"


def test_advice_expires_once_its_day_has_passed(spark):
    advice = spark.createDataFrame([("x", D(2024, 1, 1), "a"), ("x", D(2024, 1, 1), "b"), ("y", D(2024, 1, 1), "a"), ("y", D(2024, 1, 1), "gone"), ("z", D(2024, 1, 5), "a"), ("far", D(2023, 11, 1), "a"), ("eve", D(2024, 1, 3), "a")], "advice_id string, as_of date, symbol string")
    bars = spark.createDataFrame([("a", D(2024, 1, 4)), ("b", D(2024, 1, 3))], "symbol string, trade_date date")
    calendar = spark.createDataFrame([(D(2024, 1, 2), True), (D(2024, 1, 4), True), (D(2024, 1, 3), False)], "trade_date date, is_open boolean")
    got = {r.advice_id: r.expired for r in portfolio.expired(advice, bars, calendar).collect()}
    # y has a security without bars, far and z no trading day in reach, eve's day is the last bar's own
    assert got == {"x": True, "y": False, "z": False, "far": False, "eve": False}


def test_block_list_defaults(spark):
    schema = "symbol string, known_at timestamp_ntz, event_type string, sentiment_label string, sentiment_score double, relevance_score double"
    rows = [("severe", " Severe_company_risk", "", None, None), ("plain", "company_risk", "risk", -0.4, 0.9), ("score", "", "", -0.2, 0.5), ("label", "x", " BAD ", None, 0.5), ("typed", "negative_news", "", None, 0.5), ("faint", "", "bad", None, 0.1), ("fine", "", "", -0.1, 1.0)]
    items = spark.createDataFrame([(s, dt.datetime(2024, 1, 5, 12), t, label, score, r) for s, t, label, score, r in rows] + [("old", dt.datetime(2024, 1, 1, 23), "severe_company_risk", "", None, None)], schema)
    on = spark.createDataFrame([(D(2024, 1, 5),), (D(2024, 1, 8),), (D(2024, 1, 9),)], "decision_date date")
    got = lambda *a, **k: {(r.symbol, r.decision_date.day) for r in news.block_list(items, on, *a, **k).collect()}
    assert got() == {("severe", 5), ("severe", 8)}
    assert {s for s, d in got(types=(), least_relevance=0.3)} == {"plain", "score", "label", "typed"}
    assert ("old", 5) in got(days=4) and ("old", 5) not in got()
    bare = items.select("symbol", "known_at", "event_type")
    assert {r.symbol for r in news.block_list(bare, on, types=(), least_relevance=1.0).collect()} == {"typed"}


def test_downside_beta_gates_and_scores(spark):
    s = strategy.catalogue()["low_vol_defensive"]
    rows = [(D(2024, 1, 1), k, beta, 1.0, 0.1, 1.0) for k, beta in (("low", 0.5), ("mid", 1.5), ("high", 2.1), ("none", None))]
    df = spark.createDataFrame(rows, "decision_date date, symbol string, beta60 double, trend60 double, vol19 double, volx double")
    got = {r.symbol: r.score for r in strategy.ranked(df, strategy.replace(s, gate="true")).collect()}
    assert got == pytest.approx({"low": 0.625, "mid": 0.375, "none": 0.375})
    alone = {r.symbol: r.score for r in strategy.ranked(df.where("symbol = 'none'"), strategy.replace(s, gate="true")).collect()}
    # a single candidate leads every factor; the inverted one too
    assert alone == pytest.approx({"none": 1.0})


def test_the_inverse_strategy_stands_aside(spark):
    index = spark.createDataFrame([(D(2024, 1, 1) + dt.timedelta(k), 100.0 + k * (k >= 20)) for k in range(30)], "trade_date date, close double")
    df = spark.createDataFrame([(D(2024, 1, 1) + dt.timedelta(k), "a", -0.1, 0.1) for k in (5, 21, 29)], "decision_date date, symbol string, mom60s5 double, vol19 double")
    s = strategy.replace(strategy.catalogue(most_index_momentum=0.25)["inverse_momentum"], gate="true")
    got = strategy.ranked(strategy.with_index_momentum(df, index), s).orderBy("decision_date").collect()
    assert [r.decision_date.day for r in got] == [6, 22]


def test_months_and_their_summary(spark):
    days = [(D(2024, 1, 2), 100.0, None), (D(2024, 1, 30), 110.0, 50.0), (D(2024, 2, 1), 121.0, None), (D(2024, 2, 28), 108.9, 60.0), (D(2024, 3, 1), 108.9, 60.0)]
    curve = spark.createDataFrame([(d, e, -0.1 * i) for i, (d, e, _) in enumerate(days)], "trade_date date, equity double, drawdown double")
    index = spark.createDataFrame([(d, b) for d, _, b in days if b], "trade_date date, close double")
    months = execution.monthly_report(curve, index)
    got = {r.month: (round(r["return"], 9), r.benchmark_return, r.max_drawdown) for r in months.collect()}
    # February's benchmark starts from January's last value, its own return from its own first
    assert got["2024-01"] == (0.1, 0.0, -0.1) and got["2024-02"][0] == -0.1 and math.isclose(got["2024-02"][1], 0.2) and got["2024-03"][:2] == (0.0, 0.0)
    s = execution.monthly_summary(months).first()
    assert (s.months, s.positive_excess_months, s.negative_excess_months) == (3, 1, 1) and math.isclose(s.best_monthly_excess, 0.1) and math.isclose(s.worst_monthly_excess, -0.3)
    none = execution.monthly_report(curve, index.limit(0))
    assert {(r.benchmark_return, r.excess_return) for r in none.collect()} == {(None, None)}


def test_proven_validations(spark):
    given = "validation_id long, run_id long, status string, eligibility_status string, source_fingerprint string, spec_strategy string, spec_run_id long, spec_fingerprint string, as_of_date date, annual_return double, sharpe double, max_drawdown double, stressed_sharpe double, fingerprint string"
    good = (1, 7, "completed", "eligible", "p", "s", 7, "p", D(2024, 1, 1), 0.2, 1.0, -0.1, 0.5, "v")
    bad = [(2, {"status": "failed"}), (3, {"eligibility_status": "watch"}), (4, {"source_fingerprint": "q"}), (5, {"spec_strategy": "t"}), (6, {"spec_run_id": 8}), (7, {"spec_fingerprint": None}), (8, {"as_of_date": None}), (9, {"max_drawdown": 0.1}), (10, {"sharpe": None})]
    names = [f.split()[0] for f in given.split(", ")]
    rows = [good, *(tuple({**dict(zip(names, good, strict=True)), **change, "validation_id": i}[n] for n in names) for i, change in bad), (11, *good[1:])]
    v = spark.createDataFrame(rows, given)
    runs, provenance = spark.createDataFrame([(7, "s")], "run_id long, strategy_name string"), spark.createDataFrame([(7, "p")], "run_id long, fingerprint string")
    got = portfolio.strategy_candidates(v, runs, provenance).orderBy("rank").collect()
    # 0.2 * 100 + 1 * 10 - 0.1 * 40 + 0.5 * 5
    assert [(r.rank, r.validation_id, r.score) for r in got] == [(1, 11, 28.5), (2, 1, 28.5)]
    advice = [(1, "s", D(2024, 1, 1), 1, 7, "v", D(2024, 1, 1)), (2, "s", D(2024, 1, 1), 1, 7, "w", D(2024, 1, 1)), (3, "s", D(2024, 1, 2), 1, 7, "v", D(2024, 1, 1)), (4, "s", D(2024, 1, 1), 2, 7, "v", D(2024, 1, 1)), (5, "s", D(2024, 1, 1), None, 7, "v", None)]
    a = spark.createDataFrame(advice, "advice_id long, strategy_name string, as_of_date date, validation_id long, snapshot_run_id long, snapshot_fingerprint string, snapshot_as_of date")
    assert {r.advice_id: r.matches for r in portfolio.snapshot_matches(a, v, runs, provenance).collect()} == {1: True, 2: False, 3: False, 4: False, 5: False}


def test_winner_of_variants(spark):
    rows = [("a", -0.2, 0.1, 1.0), ("b", -0.2, 0.1, 1.5), ("c", -0.1, 0.0, 0.0), ("d", None, None, None), ("e", 0.0, 0.0, 0.0)]
    runs = spark.createDataFrame(rows, "run_id string, max_drawdown double, excess_return double, sharpe double")
    assert [portfolio.variant_winner(runs, x, y).first().winner for x, y in ("ab", "ca", "ac", "de")] == ["other", "base", "other", "tie"]
    traded = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "1"), ("a", "2"), ("b", "3"), ("c", "2")], "run_id string, symbol string")
    assert {tuple(r) for r in portfolio.traded_by_one(traded, "a", "b").collect()} == {("a", "2"), ("b", "3")}


def test_news_after_advice(spark):
    at = dt.datetime
    rows = [("x", "company_risk", at(2024, 1, 1, 23, 59)), ("x", "company_risk", at(2024, 1, 2, 0, 0)), ("x", "severe_company_risk", at(2024, 1, 3, 23, 0)), ("x", "company_risk", at(2024, 1, 4)), ("y", "company_risk", at(2024, 1, 2)), ("x", "neutral", at(2024, 1, 2)), ("x", "company_risk", None)]
    items = spark.createDataFrame(rows, "symbol string, event_type string, known_at timestamp_ntz")
    spans = [("a", 2, "x", D(2024, 1, 1), D(2024, 1, 3)), ("a", 2, "y", D(2024, 1, 1), D(2024, 1, 3)), ("b", 1, "z", D(2024, 1, 1), D(2024, 1, 2)), ("a", 9, "x", D(2024, 1, 1), D(2024, 1, 10))]
    got = news.outcome_counts(items, spark.createDataFrame(spans, "advice_id string, horizon int, symbol string, start_date date, end_date date"))
    assert {tuple(r) for r in got.collect()} == {("a", 2, 1, 2), ("b", 1, 0, 0), ("a", 9, 1, 2)}
