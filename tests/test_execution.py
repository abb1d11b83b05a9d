"""The execution fold against hand-made accounts, and buffers, gates and parameters of strategies."""

from __future__ import annotations

import pytest

from tessera.operators.execution import Account, Rules, fold, select_buffered
from tessera.operators.strategy import catalogue

FREE = Rules(cash=100_000, commission=0, stamp_tax=0, slippage=0)


def days(prices, decisions, volume=1.0):
    return [(f"d{i}", {s: (p[i], volume) for s, p in prices.items() if p[i] is not None}, decisions.get(i)) for i in range(len(next(iter(prices.values()))))]


def trades(out):
    return [(r[2], r[3], r[4], r[6]) for r in out if r[1] == "trade"]


def test_orders_fill_at_the_next_close():
    out = fold(days({"A": [10.0, 10.5, 10.5]}, {0: {"A": 0.5}}), FREE, "r")
    assert trades(out) == [("d1", "A", "buy", 4700)]
    assert [r[10] for r in out if r[1] == "equity"] == [100_000, 100_000, 100_000]


def test_limit_moves_block():
    assert trades(fold(days({"A": [10.0, 11.0, 11.0]}, {0: {"A": 0.5}}), FREE, "r")) == []
    sold = fold(days({"A": [10.0, 10.0, 9.0, 9.0]}, {0: {"A": 0.5}, 1: {"A": 0.0}}), FREE, "r")
    assert trades(sold) == [("d1", "A", "buy", 5000)]


def test_bought_shares_are_free_the_day_after():
    out = fold(days({"A": [10.0] * 4}, {0: {"A": 0.5}, 1: {}}), FREE, "r")
    assert trades(out) == [("d1", "A", "buy", 5000), ("d2", "A", "sell", 5000)]


def test_sales_pay_for_purchases():
    out = fold(days({"A": [10.0] * 5, "B": [20.0] * 5}, {0: {"B": 0.9}, 2: {"A": 0.9, "B": 0.0}}), FREE, "r")
    assert trades(out) == [("d1", "B", "buy", 4500), ("d3", "B", "sell", 4500), ("d3", "A", "buy", 9000)]


def test_fees_and_shrinking_to_cash():
    account = Account(Rules(cash=1_003.0))
    assert account.fee(100.0) == 5.0 and account.fee(1e6) == pytest.approx(300.0)
    assert account.buy("A", 300, 5.0, 1)[0] == 100
    assert account.cash == pytest.approx(498.0)
    assert Account(Rules(commission=0)).fee(1e9) == 0.0


def test_halted_names_do_not_trade():
    assert trades(fold(days({"A": [10.0, 10.0, 10.0]}, {0: {"A": 0.5}}, volume=0.0), FREE, "r")) == []
    out = fold(days({"A": [10.0, None, 10.0]}, {0: {"A": 0.5}}), FREE, "r")
    assert trades(out) == []


def test_buffers():
    rules = Rules(top_n=2, hold=1.5, entry=1.0)
    assert select_buffered(["a", "b", "c", "d"], {"c"}, rules) == ["c", "a"]
    assert select_buffered(["a", "b", "c", "d"], {"d"}, rules) == ["a", "b"]
    assert select_buffered(["a"], set(), rules) == ["a"] and select_buffered([], {"x"}, rules) == []


def test_parameters_are_checked():
    s = catalogue()["stable_reversal"]
    assert s.with_params(top_n=3).top_n == 3
    for bad in ({"cap": 1.5}, {"gross": -0.1}, {"top_n": 0}, {"hold": 0.5}):
        with pytest.raises(ValueError):
            s.with_params(**bad)
    assert len(catalogue()) == 10
