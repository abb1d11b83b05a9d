"""The paper portfolio: what is refused, what is repeated, and two writers."""

from __future__ import annotations

import datetime as dt

import pytest

from tessera.operators import paper
from tessera.sources.manifest import Conflict, GuardedTables

D = dt.date


@pytest.fixture
def market(spark):
    stocks = spark.createDataFrame([(s, s) for s in ("000001", "000002", "000003")], "symbol string, name string")
    bars = spark.createDataFrame([("000001", D(2024, 1, 2), 10.0), ("000002", D(2024, 1, 2), 20.0), ("000001", D(2024, 1, 3), 11.0), ("000002", D(2024, 1, 3), 0.0)], "symbol string, trade_date date, close double")
    return stocks, bars


def held(p):
    return sorted((r.symbol, r.quantity, r.reference_price) for r in p.positions().collect())


def test_snapshots(spark, tmp_path, market):
    p = paper.PaperPortfolio(spark, f"file://{tmp_path}/p")
    some = lambda *rows: spark.createDataFrame(rows, "symbol string, quantity int")
    p.save("2024-01-02", 100.126, some(("sz000001", 100), ("1", 200), ("000002", 100)), *market)
    assert held(p) == [("000001", 300, 10.0), ("000002", 100, 20.0)]
    assert [tuple(r) for r in p.valuations().collect()] == [(D(2024, 1, 2), 100.13, 5000.0, 5100.13)]
    for rows, day, words in ((some(("000009", 1)), "2024-01-03", "unknown securities: 000009"), (some(("000002", 1), ("000003", 1)), "2024-01-03", "for: 000002, 000003"), (some(("000001", 1)), "2024-01-01", "earlier")):
        with pytest.raises(paper.Refused, match=words):
            p.save(day, 1.0, rows, *market)
    assert p.state()[:2] == (0, "2024-01-02")
    # the same day again replaces, a later day adds a valuation
    p.save("2024-01-02", 5.0, some(("000001", 100)), *market)
    p.save("2024-01-03", 7.0, some(("000001", 100)), *market)
    assert sorted(tuple(r) for r in p.valuations().collect()) == [(D(2024, 1, 2), 5.0, 1000.0, 1005.0), (D(2024, 1, 3), 7.0, 1100.0, 1107.0)]
    empty = paper.PaperPortfolio(spark, f"file://{tmp_path}/q")
    empty.save("2024-01-02", 9.0, some(("000001", 1)).limit(0), *market)
    assert held(empty) == [] and [tuple(r) for r in empty.valuations().collect()] == [(D(2024, 1, 2), 9.0, 0.0, 9.0)]


def test_promotions(spark, tmp_path, market):
    p = paper.PaperPortfolio(spark, f"file://{tmp_path}/p")
    weigh = lambda *rows: spark.createDataFrame(rows, "symbol string, weight double")
    advice = weigh(("000001", 0.5), ("000002", 0.3), )
    assert p.promote("2024-01-02", 10_050.0, advice, *market) == 0
    assert held(p) == [("000001", 500, 10.0), ("000002", 100, 20.0)] and p.state()[2] == 3050.0
    assert p.promote("2024-01-02", 10_050.0, advice, *market) == 0 and p.tables.manifest.versions() == [0]
    for args, words in (
        (("2024-01-02", 10_050.0, weigh(("000001", 0.6))), "different snapshot"), (("2024-01-03", 10_050.0, weigh(("000002", 0.3))), "missing for: 000002"), (("2024-01-03", 1.0, weigh(("000001", 0.6), ("000002", 0.5))), "exceed"),
        (("2024-01-03", 1.0, weigh(("000001", float("nan")))), "exceed"), (("2024-01-03", 0.0, advice), "positive"), (("2024-01-01", 10.0, weigh(("000001", 0.1)).limit(0)), "earlier")):
        with pytest.raises(paper.Refused, match=words):
            p.promote(*args, *market)
    with pytest.raises(paper.Refused, match="because"):
        p.promote("2024-01-03", 1.0, advice, *market, reasons=["because"])
    assert p.state()[0] == 0


def test_a_margin_account_invests_more_than_its_equity(spark, tmp_path, market):
    p = paper.PaperPortfolio(spark, f"file://{tmp_path}/p")
    advice = spark.createDataFrame([("000001", 0.9), ("000002", 0.8)], "symbol string, weight double")
    with pytest.raises(paper.Refused, match="exceed"):
        p.promote("2024-01-02", 10_000.0, advice, *market, capital=1.5)
    p.promote("2024-01-02", 10_000.0, advice, *market, capital=2.0)
    assert held(p) == [("000001", 900, 10.0), ("000002", 400, 20.0)] and p.state()[2] == -7000.0
    assert [tuple(r) for r in p.valuations().collect()] == [(D(2024, 1, 2), -7000.0, 17000.0, 10000.0)]


def test_of_two_writers_one_is_refused(spark, tmp_path, market):
    one, two = (paper.PaperPortfolio(spark, f"file://{tmp_path}/p") for _ in range(2))
    rows = spark.createDataFrame([("000001", 100)], "symbol string, quantity int")
    seen = two.state()[0]
    one.save("2024-01-02", 1.0, rows, *market)
    with pytest.raises(Conflict):
        two.save("2024-01-02", 2.0, rows, *market, seen=seen)
    assert one.valuations().first().cash == 1.0 and one.valuations().count() == 1


def test_validations_and_their_cemetery(spark, tmp_path):
    tables = GuardedTables(spark, f"file://{tmp_path}/v")
    schema = "validation_id int, run_id int, strategy_name string, eligibility_status string, flags array<string>, fingerprint string"
    rows = [(1, 1, "m", "eligible", ["x"], "a"), (2, 1, None, "watch", ["few", None, "late"], "b"), (3, 1, "m", "rejected", [], "c")]
    first = spark.createDataFrame(rows, schema)
    assert paper.save_validations(tables, first) == 0 and paper.save_validations(tables, first) == 0
    more = spark.createDataFrame([*rows, (4, 2, "n", "watch", None, "d"), (4, 2, "n", "watch", None, "d")], schema)
    with pytest.raises(Conflict):
        paper.save_validations(tables, more, seen=-1)
    assert tables.table("validations").count() == 3 and tables.table("cemetery").count() == 2
    assert paper.save_validations(tables, more) == 1
    assert sorted((r.source_ref, r.subject_name, r.reason) for r in tables.table("cemetery").collect()) == [("2", "unknown_strategy", "few; late"), ("3", "m", "rejected"), ("4", "n", "watch")]


def test_promotion_reasons_by_hand(spark):
    day = D(2024, 6, 30)
    base = dict(advice_id=1, strategy_name="m", as_of_date=day, status="reviewed", reviewed_at=day, has_evidence=True, validation_id=1, ev_run_id=7, ev_fingerprint="f", ev_as_of=day)
    cases = [
        {}, {"status": "draft"}, {"reviewed_at": None}, {"has_evidence": False, "status": "draft"}, {"validation_id": 0}, {"validation_id": 99}, {"validation_id": 2}, {"validation_id": 3}, {"validation_id": 4}, {"validation_id": 5},
        {"ev_fingerprint": "old"}, {"validation_id": None}]
    advice = [{**base, **c, "advice_id": k} for k, c in enumerate(cases)]
    names = list(base)
    schema = "advice_id int, strategy_name string, as_of_date date, status string, reviewed_at date, has_evidence boolean, validation_id int, ev_run_id int, ev_fingerprint string, ev_as_of date"
    # 2: not eligible, one window; 3: a run without provenance; 4: windows overlap; 5: ends too early
    validations = [(k, 8 if k == 3 else 7, "completed", "watch" if k == 2 else "eligible", "p", "m", 8 if k == 3 else 7, "p", "f") for k in range(1, 6)]
    windows = [(k, D(2024, m, 1), D(2024, m, 29 if k == 5 and m == 6 else 30), True) for k in (1, 3, 4, 5) for m in (4, 5, 6)] + [(2, D(2024, 6, 1), day, True), (4, D(2024, 4, 15), D(2024, 4, 20), True)]
    out = paper.promotion_eligibility(
        spark.createDataFrame([tuple(a[n] for n in names) for a in advice], schema), spark.createDataFrame([(0, False), (10, True)], "advice_id int, expired boolean"),
        spark.createDataFrame(validations, "validation_id int, run_id int, status string, eligibility_status string, source_fingerprint string, spec_strategy string, spec_run_id int, spec_fingerprint string, fingerprint string"),
        spark.createDataFrame([(7, "m"), (8, "m")], "run_id int, strategy_name string"), spark.createDataFrame([(7, "p")], "run_id int, fingerprint string"),
        spark.createDataFrame(windows, "validation_id int, oos_start date, oos_end date, has_result boolean"))
    key = {v: k for k, v in paper.REASONS.items()}
    got = {r.advice_id: ([key[x] for x in r.reasons], r.oos_window_count, r.eligible) for r in out.collect()}
    assert got == {
        0: ([], 3, True), 1: (["review"], 3, False), 2: (["review"], 3, False), 3: (["review", "no_evidence"], 0, False), 4: (["bad_id"], 0, False), 5: (["gone"], 0, False), 6: (["not_eligible", "few_windows"], 1, False),
        7: (["no_source"], 0, False), 8: (["bad_windows"], 0, False), 9: (["late_window"], 3, False), 10: (["expired", "mismatch"], 3, False), 11: (["bad_id"], 0, False)}
