"""Boosted trees of many windows against trees grown by hand, and the feature matrix."""

from __future__ import annotations

import datetime as dt
import random
import statistics

import numpy as np
import pytest

from tessera.operators import boosting as B
from tessera.operators import ml as M

FIRST = dt.date(2020, 1, 1)


def rows_of(seed, days=60, symbols=30):
    rng = random.Random(seed)
    out = []
    for k in range(days):
        for s in range(symbols):
            x = [rng.gauss(0, 1), rng.choice([0.0, 1.0]), rng.gauss(0, 1)]
            out.append((FIRST + dt.timedelta(k), f"{s:06d}", *x, 0.1 * x[0] * (1 if x[1] else -1) + rng.gauss(0, 0.02)))
    return out


def day(k):
    return FIRST + dt.timedelta(k)


SCHEMA = "trade_date date, symbol string, a double, b double, c double, fwd_5d double"
WINDOWS = "window_id int, train_start date, train_end date, valid_start date, valid_end date, test_start date, test_end date"


def grow(x, y, f, s):
    """One tree by trying every split of every open leaf."""
    g = np.rint((y - f) * B.UNIT).astype(np.int64)
    value = lambda at: s.rate * (g[at].sum() / B.UNIT) / (at.sum() + s.l2)
    part = lambda at: (g[at].sum() / B.UNIT) ** 2 / (at.sum() + s.l2)
    leaves, tree = {0: np.ones(len(x), bool)}, {}
    for _ in range(s.depth):
        best = []
        for node, at in leaves.items():
            if node in tree or node < 2 ** _ - 1:
                continue
            found = None
            for k in range(x.shape[1]):
                for t in range(s.bins):
                    left, right = at & (x[:, k] <= t), at & (x[:, k] > t)
                    if min(left.sum(), right.sum()) >= s.least_rows and (at & (x[:, k] == t)).any():
                        gain = part(left) + part(right) - part(at)
                        if found is None or gain > found[0]:
                            found = (gain, k, t, left, right)
            if found and found[0] > 1e-12:
                best.append((-found[0], node, found))
        room = s.leaves - len(leaves)
        for _g, node, found in sorted(best, key=lambda b: b[:2])[:room]:
            tree[node] = found[1:3]
            del leaves[node]
            leaves[2 * node + 1], leaves[2 * node + 2] = found[3], found[4]
    out = np.zeros(len(x))
    for at in leaves.values():
        out[at] = value(at)
    return tree, out


@pytest.mark.parametrize("settings", [B.Settings(rounds=3, depth=3, bins=8, patience=9), B.Settings(rounds=2, depth=3, leaves=3, bins=8, patience=9)])
def test_splits_equal_a_tree_grown_by_hand(spark, settings):
    data = spark.createDataFrame(rows_of(1), SCHEMA).repartition(5)
    spans = {0: (0, 29), 1: (10, 39)}
    windows = spark.createDataFrame([(w, day(a), day(b), day(b + 1), day(b + 5), day(b + 6), day(b + 12)) for w, (a, b) in spans.items()], WINDOWS)
    walk = B.walk_forward(data, windows, ["a", "b", "c"], "fwd_5d", settings)
    table = data.toPandas()
    edges = B.quantile_edges(data.where(f"trade_date <= '{day(29)}'"), ["a", "b", "c"], settings.bins)
    k = np.array([(d - FIRST).days for d in table.trade_date])
    x = np.column_stack([np.searchsorted(edges[i], table[n].to_numpy(), "left") for i, n in enumerate("abc")])
    y = table.fwd_5d.to_numpy()
    for w, (lo, hi) in spans.items():
        own = (k >= lo) & (k <= hi)
        base = np.rint(y[own] * B.UNIT).astype(np.int64).sum() / own.sum() / B.UNIT
        f = np.full(own.sum(), base)
        assert walk.models[w].base == pytest.approx(base)
        for tree in walk.models[w].trees:
            want, add = grow(x[own], y[own], f, settings)
            got = {int(n): (int(tree.feature[n]), int(tree.at[n])) for n in np.flatnonzero(tree.feature >= 0)}
            assert got == want
            f = f + add
        assert len(walk.models[w].trees) == settings.rounds
    scores = walk.scores.collect()
    assert len(scores) == 2 * 7 * 30 and np.corrcoef([r.score for r in scores], [r.label for r in scores])[0, 1] > 0.5
    shares = dict(walk.importance())
    assert sum(shares.values()) == pytest.approx(1) and shares["a"] > shares["c"]


def test_noise_stops_early_and_empty_windows_have_no_model(spark):
    rng = random.Random(3)
    rows = [(d, s, a, b, c, rng.gauss(0, 1)) for d, s, a, b, c, _ in rows_of(2)]
    data = spark.createDataFrame([*rows, (day(3), "x", None, None, None, 0.1), (day(3), "y", 1.0, 1.0, 1.0, None)], SCHEMA)
    windows = spark.createDataFrame([(0, day(0), day(29), day(30), day(34), day(35), day(40)), (1, day(0), day(29), day(30), day(34), day(200), day(210))], WINDOWS)
    walk = B.walk_forward(data, windows, ["a", "b", "c"], "fwd_5d", B.Settings(rounds=12, depth=2, bins=8, patience=2, rate=0.5))
    m = walk.models[0]
    assert 1 <= m.best == 1 + int(np.argmin(m.errors[1:])) and len(m.errors) - 1 - m.best == 2 and len(m.trees) < 12
    assert {r.window_id for r in walk.scores.collect()} == {0} and not walk.models[1].trees
    assert B.walk_forward(data, windows.limit(0), ["a"], "fwd_5d").scores.count() == 0


def test_feature_columns_come_from_the_schema(spark):
    df = spark.createDataFrame([], "trade_date date, symbol string, split string, x double, n int, name string, fwd_5d double, fwd_10d double, d decimal(9,2)")
    assert M.feature_columns(df, "fwd_5d") == ["x", "n", "d"]
    with pytest.raises(ValueError):
        M.feature_columns(df, "fwd_1d")
    with pytest.raises(ValueError):
        M.feature_columns(df.select("trade_date", "fwd_5d", "fwd_10d"), "fwd_5d")


def test_standardised_by_hand(spark):
    rng = random.Random(5)
    rows = [(day(k), f"s{i}", rng.choice([None, rng.gauss(0, 1), rng.gauss(0, 30)]), 2.0 if i else 3.0, None) for k in range(4) for i in range(1 + 7 * k)]
    got = {(r.trade_date, r.symbol): r for r in M.standardised(spark.createDataFrame(rows, "trade_date date, symbol string, x double, same double, none double"), ["x", "same", "none"]).collect()}
    for d in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == d]
        for place, name in ((2, "x"), (3, "same")):
            values = [r[place] for r in own if r[place] is not None]
            if not values:
                continue
            m = statistics.median(values)
            spread = statistics.median([abs(v - m) for v in values])
            limit = 3 * 1.4826 * spread
            clipped = [min(max(v, m - limit), m + limit) if spread else v for v in values]
            # the medians of the clipped values, which the two passes rely on
            m2 = statistics.median(clipped)
            d2 = statistics.median([abs(v - m2) for v in clipped])
            for r, v in zip([r for r in own if r[place] is not None], clipped, strict=True):
                want = (v - m2) / (1.4826 * d2) if d2 else v - m2
                assert got[r[:2]][name] == pytest.approx(want)
    assert all(r.none is None for r in got.values()) and all((got[r[:2]].x is None) == (r[2] is None) for r in rows)


def test_medians_are_sorted_by_date_and_part(spark):
    rng, names = random.Random(8), [f"c{k}" for k in range(20)]
    rows = [(day(k), *(rng.choice([None, rng.gauss(0, 1), 2.0]) if i % 20 else None for i in range(20))) for k in range(3) for _ in range(1 + 9 * k)]
    found = M.medians(spark.createDataFrame(rows, "trade_date date, " + ", ".join(f"{n} double" for n in names)), names)
    # no aggregate holds a map of a date's values
    assert "median" not in found._jdf.queryExecution().optimizedPlan().toString().replace("_median", "")
    got = {r.trade_date: r for r in found.collect()}
    for d in {r[0] for r in rows}:
        for k, n in enumerate(names, 1):
            values = [r[k] for r in rows if r[0] == d and r[k] is not None]
            m = statistics.median(values) if values else None
            assert got[d][f"_m_{n}"] == (pytest.approx(m) if values else None)
            assert got[d][f"_d_{n}"] == (pytest.approx(statistics.median([abs(v - m) for v in values])) if values else None)
