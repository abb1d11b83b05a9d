"""Learning-to-rank chain: feature matrix, dataset, embargoed windows, walk-forward scores, diagnostics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.factors import REGISTRY, compute
from tessera.operators import boosting
from tessera.operators.evaluation import MAD_SCALE, factor_rows, part_values
from tessera.operators.grid import dense_grid, forward_returns
from tessera.session import Folder


#: Columns of a dataset that are no features.
INDEX_COLUMNS = ("trade_date", "symbol", "split", "window_id", "score")


def feature_columns(data: DataFrame, label: str) -> list[str]:
    """The features of a dataset by its schema: numbers that are neither index columns nor labels, in the order of the columns."""
    if label not in data.columns:
        raise ValueError(f"the dataset has no label {label}")
    numbers = ("double", "float", "int", "bigint", "smallint", "tinyint")
    found = [c for c, t in data.dtypes if c not in INDEX_COLUMNS and c != label and not c.startswith("fwd_") and (t in numbers or t.startswith("decimal"))]
    if not found:
        raise ValueError("the dataset has no feature columns")
    return found


def _middle(ordered: np.ndarray) -> float:
    low, high = ordered[(len(ordered) - 1) // 2], ordered[len(ordered) // 2]
    return float(low if low == high else 0.5 * low + 0.5 * high)


def medians(panel: DataFrame, names: list[str]) -> DataFrame:
    """trade_date and for each column its exact median on the date, _m_, and that of its absolute deviations, _d_; null without values."""

    def each(key, table):
        _, xs, there = part_values(key, table, names)
        found = []
        for j in range(xs.shape[1]):
            values = np.sort(xs[there[:, j], j])
            m = _middle(values) if len(values) else None
            found.append((m, None if m is None else _middle(np.sort(np.abs(values - m)))))
        m, d = ([f[k] for f in found] for k in (0, 1))
        kind = pa.list_(pa.float64())
        return pa.table({"trade_date": pa.array([key[0].as_py()], pa.date32()), "part": pa.array([key[1].as_py()], pa.int32()), "m": pa.array([m], kind), "d": pa.array([d], kind)})

    parts = factor_rows(panel, names).groupBy("trade_date", "part").applyInArrow(each, "trade_date date, part int, m array<double>, d array<double>")
    # a row holds two numbers a column
    whole = parts.groupBy("trade_date").agg(F.array_sort(F.collect_list(F.struct("part", "m", "d"))).alias("p"))
    flat = whole.select("trade_date", F.flatten("p.m").alias("m"), F.flatten("p.d").alias("d"))
    return flat.select("trade_date", *(F.col(c)[k].alias(f"_{c}_{n}") for k, n in enumerate(names) for c in ("m", "d")))


def standardised(panel: DataFrame, names: list[str], k: float = 3.0) -> DataFrame:
    """Every named column as the robust z-score of its date, clipped to k scaled deviations before; the other columns stay.

    Clipping moves neither a date's median nor the median of its deviations
    (both lie well within the limits), so the exact medians of all columns and
    all dates are taken first: a task sorts one date's values of a few columns,
    and a row a date comes back. The panel is read twice: give one that is
    written, or cheap.
    """
    found = medians(panel, names)
    # limits and scale are made on the few rows of dates
    limits = {n: F.col(f"_d_{n}") * MAD_SCALE * k for n in names}
    sides = found.select("trade_date", *(x for n in names for x in (
        f"_m_{n}", f"_d_{n}", (F.col(f"_m_{n}") - limits[n]).alias(f"_lo_{n}"), (F.col(f"_m_{n}") + limits[n]).alias(f"_hi_{n}"), (F.col(f"_d_{n}") * MAD_SCALE).alias(f"_s_{n}"))))
    both = panel.join(F.broadcast(sides), "trade_date")

    def z(n: str):
        x, m = F.col(n), F.col(f"_m_{n}")
        clipped = F.greatest(F.col(f"_lo_{n}"), F.least(F.col(f"_hi_{n}"), x))
        return F.when(F.col(f"_d_{n}") == 0, x - m).when(x.isNotNull(), (clipped - m) / F.col(f"_s_{n}")).alias(n)

    kept = [c for c in panel.columns if c not in names]
    return both.select(*kept, *(z(n) for n in names))


def factor_matrix(bars: DataFrame, names: list[str] | None = None, horizons: tuple[int, ...] = (5, 10), digits: int | None = None) -> DataFrame:
    """trade_date, symbol, labels and every named factor (all of the registry by default), oriented and standardised by date; nulls stay.

    The panel of factors and labels is computed once, in one ordering by
    security, and written to the shared folder; the passes over it read that
    table. ``digits`` rounds the factors before.
    """
    names = list(REGISTRY) if names is None else names
    labels = tuple(f"fwd_{h}d" for h in horizons)
    panel = compute(forward_returns(dense_grid(bars), horizons), names, keep=labels)
    oriented = [(F.col(n) * REGISTRY[n].direction).alias(n) for n in names]
    if digits is not None:
        oriented = [(F.round(n, digits) * REGISTRY[n].direction).alias(n) for n in names]
    folder = Folder(bars.sparkSession, "matrix")
    # a file holds few dates, so a task of the passes over them keeps few groups
    panel.select("trade_date", "symbol", *labels, *oriented).repartition("trade_date").write.parquet(folder.path("panel"))
    return standardised(bars.sparkSession.read.parquet(folder.path("panel")), names)


def dataset(bars: DataFrame, names: list[str], horizons: tuple[int, ...] = (5,)) -> DataFrame:
    """trade_date, symbol, oriented z-scores, labels; rows with any null are left out. One grid, no join of features and labels."""
    matrix = factor_matrix(bars, names, horizons)
    return matrix.select("trade_date", "symbol", *names, *(f"fwd_{h}d" for h in horizons)).dropna()


def calendar_windows(dates: DataFrame, train_months: int = 12, valid_months: int = 2, test_months: int = 1, embargo_days: int = 15) -> DataFrame:
    """window_id with inclusive train, valid and test spans by calendar month; training and validation end ``embargo_days`` before what follows."""
    ends = dates.agg(F.trunc(F.min("trade_date"), "month").alias("lo"), F.max("trade_date").alias("hi"))
    months = train_months + valid_months + test_months
    starts = ends.select("hi", F.posexplode(F.sequence("lo", "hi", F.expr(f"interval {test_months} month"))).alias("window_id", "train_start"))
    at = lambda m: F.add_months("train_start", m)
    out = starts.where(at(months) <= F.date_add("hi", 1))
    return out.select(
        "window_id", "train_start", F.date_sub(at(train_months), embargo_days + 1).alias("train_end"), at(train_months).alias("valid_start"),
        F.date_sub(at(train_months + valid_months), embargo_days + 1).alias("valid_end"), at(train_months + valid_months).alias("test_start"), F.date_sub(at(months), 1).alias("test_end"))


def walk_forward(data: DataFrame, windows: DataFrame, names: list[str], label: str, rounds: int = 10, depth: int = 4) -> DataFrame:
    """Rows of every test span with window_id and the score of the boosted trees of their own window; ``boosting`` says how these grow."""
    walk = boosting.walk_forward(data, windows, names, label, boosting.Settings(rounds=rounds, depth=depth))
    return data.join(walk.scores.select("trade_date", "symbol", "window_id", "score"), ["trade_date", "symbol"])


def rank_ic_by_date(scores: DataFrame, label: str) -> DataFrame:
    """Rank IC of each date with at least two distinct scores and labels."""
    from tessera.operators.evaluation import complete_pairs, daily_ic

    pairs = complete_pairs(scores, "score", label, 2)
    enough = pairs.groupBy("trade_date").agg(F.countDistinct("x").alias("a"), F.countDistinct("y").alias("b")).where("a >= 2 and b >= 2").select("trade_date")
    return daily_ic(pairs.join(enough, "trade_date", "left_semi"))


def ml_targets(scores: DataFrame, gaps: DataFrame, blocked: DataFrame, liquid: DataFrame, least_score: float | None = None) -> DataFrame:
    """decision_date, symbol, score, rank: same-date scores (never carried forward) without gaps, blocked or illiquid names."""
    out = scores.select(F.col("trade_date").alias("decision_date"), "symbol", "score")
    out = out.join(gaps.select(F.col("trade_date").alias("decision_date"), "symbol"), ["decision_date", "symbol"], "left_anti")
    out = out.join(blocked.select("decision_date", "symbol"), ["decision_date", "symbol"], "left_anti").join(liquid.select("decision_date", "symbol"), ["decision_date", "symbol"], "left_semi")
    if least_score is not None:
        out = out.where(F.col("score") >= least_score)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("decision_date").orderBy(F.desc("score"), "symbol")))
