"""Small rules, worked by hand."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.operators import desk, regime, repository

D = dt.date


def test_bar_errors(spark):
    schema = "symbol string, trade_date date, open double, high double, low double, close double, volume double, amount double"
    good = [10.0, 11.0, 9.0, 10.0, 0.0, 0.0]

    def bars(symbol, *changes):
        rows = []
        for k in range(4):
            row = dict(zip(("open", "high", "low", "close", "volume", "amount"), good, strict=True))
            row.update(next((c for at, c in changes if at == k), {}))
            rows.append((symbol, D(2024, 1, 1 + k), *row.values()))
        return rows

    rows = bars("fine") + bars("nan", (1, {"close": None}), (3, {"close": float("nan")}), (2, {"open": -1.0})) + bars("price", (0, {"low": 0.0}), (2, {"low": -1.0})) + bars("shape", (1, {"high": 9.5}), (3, {"low": 12.0}))
    got = {r.symbol: tuple(r)[1:] for r in repository.bar_errors(spark.createDataFrame(rows, schema).repartition(3), "feed").collect()}
    assert got == {
        "nan": ("nan_value", "close", [1, 3], "feed: nan_value in close at row indices [1, 3]"), "price": ("invalid_price", "low", [0, 2], "feed: invalid_price in low at row indices [0, 2]"),
        "shape": ("ohlc_contradiction", "high,low", [1, 3], "feed: high < max(open, close, low) at row indices [1, 3]; low > min(open, close, high) at row indices [3]")}
    bare = repository.bar_errors(spark.createDataFrame(rows, schema).drop("amount", "low"), "feed").where("symbol = 'fine'").first()
    assert (bare.kind, bare.column, bare.message) == ("missing_column", "low,amount", "feed: missing columns: low, amount")


def test_exits_and_watchers(spark):
    rows = [(0, False, True, 3), (5, True, True, 3), (5, False, True, 3), (5, False, False, 0), (5, False, False, 2), (None, False, False, 2)]
    df = spark.createDataFrame(rows, "remaining int, completed boolean, blocked boolean, processed int")
    assert [r[0] for r in df.select(desk.exit_reason(*map(F.col, df.columns))).collect()] == ["completed", "completed", "blocked", "idle", "continue", "completed"]
    rows = [("completed", 3, 1), ("idle", 0, 1), ("idle", 3, 0), ("idle", 3, 1), ("continue", 3, 0), (None, None, 0)]
    df = spark.createDataFrame(rows, "reason string, remaining int, code int")
    assert [tuple(r[0]) for r in df.select(desk.stop_watching(*map(F.col, df.columns))).collect()] == [(True, "completed"), (True, "completed"), (True, "idle"), (False, "idle"), (False, "continue"), (False, "continue")]


def test_buffers_keep_what_is_held(spark):
    ranks = spark.createDataFrame([(1, f"s{k}", k) for k in range(1, 9)] + [(2, "s1", 1)], "decision_date int, symbol string, rank int")
    held = spark.createDataFrame([(1, "s4"), (1, "s4"), (1, "s6"), (1, "s8"), (2, "s9")], "decision_date int, symbol string")
    got = sorted((r.decision_date, r.symbol, round(r.weight, 4)) for r in desk.buffered(ranks, held, 4, 1.5, 1.0, 0.3, 0.8).collect())
    # s4 and s6 stay (rank 6 is the last that is held), s1 and s2 come in, s3 finds no place, s8 is beyond the buffer
    assert got == [(1, "s1", 0.2), (1, "s2", 0.2), (1, "s4", 0.2), (1, "s6", 0.2), (2, "s1", 0.3)]


def test_weights_over_symbols_and_positions(spark):
    raw = spark.createDataFrame([(1, "a", 0.5), (1, "b", float("inf")), (1, "z", 0.1)], "run_id int, symbol string, weight double")
    pairs = lambda *x: spark.createDataFrame([(1, s) for s in x], "run_id int, symbol string")
    got = {r.symbol: (r.weight, r.problem) for r in desk.normalised_weights(raw, pairs("a", "b"), pairs("b", "c")).collect()}
    assert got == {"a": (0.5, None), "b": (None, "not_finite"), "c": (0.0, None)}


def test_critique(spark):
    day = D(2024, 6, 1)
    advice = spark.createDataFrame([
        (1, day, "reviewed", day, day, 0, True, True), (2, day, "expired", D(2024, 6, 2), None, 2, True, False), (3, day, "draft", None, D(2024, 6, 3), None, False, None)],
        "advice_id int, as_of_date date, status string, market_end date, factor_end date, severe_count int, has_validation boolean, validation_matches boolean")
    news = spark.createDataFrame([(1, D(2024, 6, 1)), (3, D(2024, 6, 9)), (3, D(2024, 6, 5))], "advice_id int, known_at date")
    weights = spark.createDataFrame([(1, 0.3), (2, 0.31), (2, 0.1)], "advice_id int, weight double")
    got = {r.advice_id: ([(f.code, f.citation) for f in r.findings], r.approved_for_human_review) for r in desk.critique(advice, news, weights).collect()}
    assert got[1] == ([], True)
    assert got[2] == ([("future_market_evidence", "2024-06-02"), ("severe_company_news", "persisted news evidence"), ("concentrated_target", "risk-gated target weights"), ("invalid_oos_validation", "advisory evidence snapshot"), ("expired_draft", "2024-06-01")], False)
    assert got[3] == ([("future_factor_evidence", "2024-06-03"), ("future_news_evidence", "2024-06-05"), ("missing_oos_validation", "advisory evidence snapshot")], False)


def test_calendar_and_fallbacks(spark):
    c = spark.createDataFrame([(D(2024, 1, d), d != 3) for d in (1, 2, 3, 4)], "trade_date date, is_open boolean")
    fresh = spark.createDataFrame([(D(2024, 1, 3), False), (D(2024, 1, 3), True), (D(2024, 1, 4), False)], "trade_date date, is_open boolean")
    days = lambda x, a=1, b=9: [r.trade_date.day for r in desk.trading_dates(x, f"2024-01-0{a}", f"2024-01-0{b}").collect()]
    assert days(c) == [1, 2, 4] and days(c, 2, 3) == [2] and days(desk.upsert_calendar(c, fresh)) == [1, 2, 3]
    one, none = spark.createDataFrame([("a",), ("a",)], "symbol string"), spark.createDataFrame([], "symbol string")
    assert desk.first_that_has_rows(none, one).count() == 2 and desk.first_that_has_rows(none, none).count() == 0
    assert [(r.symbol, r.degraded) for r in desk.snapshot_universe("manual", one, None).collect()] == [("a", True)]
    with pytest.raises(ValueError):
        desk.snapshot_universe("index", one, one)
    jobs = spark.createDataFrame([(1, "a", D(2024, 1, 1)), (2, "a", D(2024, 1, 1)), (3, "b", D(2024, 1, 2)), (4, "a", D(2023, 1, 1))], "job_id int, target string, created_at date")
    assert [r.job_id for r in desk.latest(jobs, {"target": "a"}, "created_at", "job_id", 2).collect()] == [2, 1]


def test_regime_reasons(spark):
    index = spark.createDataFrame([("i", D(2023, 1, 1) + dt.timedelta(k), 100.0 + k if k < 130 else 230.0 - 3 * (k - 130)) for k in range(150)], "symbol string, trade_date date, close double")
    rows = regime.reasons(regime.classify(regime.index_metrics(index))).orderBy("trade_date").collect()
    assert rows[5].reasons == ["Only 6 bars (< 20); insufficient for regime classification."]
    assert rows[125].reasons[:2] == ["MA20(215.50) > MA60(195.50) — golden cross zone", "距20日高点 +0.0%"] and len(rows[125].reasons) == 3
    last = rows[149].reasons
    assert last[1] == "距20日高点 -24.8%" and last[2] == "24.8% 从120日高点回撤" and last[-1] in regime.RULE_REASONS
