"""Cross-sectional preprocessing and factor evaluation."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.windows import average_rank, bucket, ratio

MAD_SCALE = 1.4826


def winsorize(df: DataFrame, x: str, k: float = 3.0, date: str = "trade_date") -> DataFrame:
    """Clip to median +- k scaled median absolute deviations of the date; dates without spread stay."""
    w = Window.partitionBy(date)
    df = df.withColumn("_med", F.median(x).over(w)).withColumn("_mad", F.median(F.abs(F.col(x) - F.col("_med"))).over(w))
    limit = F.col("_mad") * MAD_SCALE * k
    clipped = F.greatest(F.col("_med") - limit, F.least(F.col("_med") + limit, F.col(x)))
    return df.withColumn(x, F.when(F.col(x).isNull() | (F.col("_mad") == 0), F.col(x)).otherwise(clipped)).drop("_med", "_mad")


def robust_z(df: DataFrame, x: str, out: str, date: str = "trade_date") -> DataFrame:
    """(x - median) / (1.4826 MAD) by date; x - median where the date has no spread."""
    w = Window.partitionBy(date)
    df = df.withColumn("_med", F.median(x).over(w)).withColumn("_mad", F.median(F.abs(F.col(x) - F.col("_med"))).over(w))
    away = F.col(x) - F.col("_med")
    return df.withColumn(out, F.when(F.col("_mad") == 0, away).otherwise(away / (F.col("_mad") * MAD_SCALE))).drop("_med", "_mad")


def percentile_rank(df: DataFrame, x: str, out: str, date: str = "trade_date") -> DataFrame:
    """Average rank over count of the present values, by date."""
    n = F.count(x).over(Window.partitionBy(date))
    ranked = df.withColumn("_null", F.col(x).isNull())
    rank = average_rank(x, date, "_null")
    return ranked.withColumn(out, F.when(F.col(x).isNotNull(), rank / n)).drop("_null")


def preprocess(df: DataFrame, x: str, k: float = 3.0) -> DataFrame:
    """Winsorised value, its robust z-score and its percentile rank."""
    df = robust_z(winsorize(df, x, k), x, "z")
    return percentile_rank(df, x, "pct")


def composite(df: DataFrame, weights: dict[str, tuple[float, int]], out: str = "composite") -> DataFrame:
    """sum(direction * z * weight) / sum |weight| of factors; null where a component is null."""
    if not weights or any(w == 0 for w, _ in weights.values()):
        raise ValueError("a composite needs factors with weights other than 0")
    for name in weights:
        df = robust_z(winsorize(df, name), name, f"_z_{name}")
    total = None
    for name, (w, d) in weights.items():
        part = F.col(f"_z_{name}") * (w * d)
        total = part if total is None else total + part
    return df.withColumn(out, total / sum(abs(w) for w, _ in weights.values())).drop(*(f"_z_{n}" for n in weights))


def complete_pairs(df: DataFrame, x: str, y: str, least: int) -> DataFrame:
    """trade_date, symbol, x, y where both are present, on dates with at least ``least`` of them."""
    pairs = df.select("trade_date", "symbol", F.col(x).alias("x"), F.col(y).alias("y")).dropna(subset=["x", "y"])
    n = F.count(F.lit(1)).over(Window.partitionBy("trade_date"))
    return pairs.withColumn("_n", n).where(F.col("_n") >= least).drop("_n")


def _corr(a: str, b: str) -> Column:
    return ratio(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def daily_ic(pairs: DataFrame) -> DataFrame:
    """trade_date, n, ic (Pearson) and rank_ic (Spearman with average ranks)."""
    ranked = pairs.withColumns({"_rx": average_rank("x", "trade_date"), "_ry": average_rank("y", "trade_date")})
    return ranked.groupBy("trade_date").agg(F.count(F.lit(1)).alias("n"), _corr("x", "y").alias("ic"), _corr("_rx", "_ry").alias("rank_ic"))


def ic_summary(daily: DataFrame) -> DataFrame:
    """Means, sample deviations and information ratios (null below two dates or without spread)."""
    stats = []
    for c in ("ic", "rank_ic"):
        stats += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"), ratio(F.avg(c), F.stddev_samp(c)).alias(f"{c}_ir")]
    return daily.agg(*stats, F.count(F.lit(1)).alias("n_dates"))


def with_bucket(pairs: DataFrame, groups: int) -> DataFrame:
    """Quantile bucket of x by date."""
    return pairs.withColumn("bucket", bucket("x", groups))


def group_returns(bucketed: DataFrame) -> DataFrame:
    """Mean of y by date and bucket, then over dates with equal weight."""
    daily = bucketed.groupBy("trade_date", "bucket").agg(F.avg("y").alias("m"))
    return daily.groupBy("bucket").agg(F.avg("m").alias("mean_return"), F.count(F.lit(1)).alias("n_dates"))


def long_short(bucketed: DataFrame, groups: int) -> DataFrame:
    """Top minus bottom bucket by date."""
    side = lambda b: F.avg(F.when(F.col("bucket") == b, F.col("y")))
    return bucketed.groupBy("trade_date").agg((side(groups) - side(1)).alias("long_short"))


def turnover(bucketed: DataFrame) -> DataFrame:
    """Half the absolute weight change between consecutive evaluated dates, averaged, by bucket.

    Each weight is emitted at its date and, negated, at the next evaluated
    date; what is left of a symbol's sum is its change.
    """
    dates = bucketed.select("trade_date").distinct().withColumn("idx", F.row_number().over(Window.orderBy("trade_date")))
    n = F.count(F.lit(1)).over(Window.partitionBy("trade_date", "bucket"))
    held = bucketed.withColumn("w", 1.0 / n).join(F.broadcast(dates), "trade_date").select("bucket", "symbol", "idx", "w")
    ends = dates.agg(F.max("idx").alias("last"))
    moves = held.unionByName(held.select("bucket", "symbol", (F.col("idx") + 1).alias("idx"), (-F.col("w")).alias("w")))
    moves = moves.join(F.broadcast(ends), F.col("idx") <= F.col("last"))
    change = moves.groupBy("bucket", "idx", "symbol").agg(F.sum("w").alias("dw"))
    daily = change.where("idx >= 2").groupBy("bucket", "idx").agg((F.sum(F.abs("dw")) / 2).alias("t"))
    return daily.groupBy("bucket").agg(F.avg("t").alias("turnover"))


def spread_turnover(bucketed: DataFrame, groups: int, key: str) -> DataFrame:
    """key, long_short_turnover: mean of the top and the bottom bucket's turnover, by a key.

    Of two equal-weighted sets with n and m names of which k are in both, the
    turnover is ((n - k) / n + (m - k) / m + k |1/m - 1/n|) / 2, so each name
    only needs its row before. Keys with one date have none (0).
    """
    dates = bucketed.select(key, "trade_date").distinct().withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy("trade_date")))
    ends = bucketed.where(F.col("bucket").isin(1, groups)).join(dates, [key, "trade_date"])
    before = Window.partitionBy(key, "symbol").orderBy("_i")
    stays = (F.lag("_i").over(before) == F.col("_i") - 1) & (F.lag("bucket").over(before) == F.col("bucket"))
    sizes = ends.withColumn("_k", F.coalesce(stays, F.lit(False))).groupBy(key, "bucket", "_i").agg(F.count(F.lit(1)).alias("m"), F.count_if("_k").alias("k"))
    sizes = sizes.withColumn("n", F.lag("m").over(Window.partitionBy(key, "bucket").orderBy("_i")))
    each = ((F.col("n") - F.col("k")) / F.col("n") + (F.col("m") - F.col("k")) / F.col("m") + F.col("k") * F.abs(1.0 / F.col("m") - 1.0 / F.col("n"))) / 2
    by_bucket = sizes.groupBy(key, "bucket").agg(F.coalesce(F.avg(each), F.lit(0.0)).alias("t"))
    return by_bucket.groupBy(key).agg((F.sum("t") / 2).alias("long_short_turnover"))


def stability(panel: DataFrame, x: str, y: str, groups: int, folds: int = 3, least_dates: int = 20) -> DataFrame:
    """Consecutive folds of all dates, each evaluated for itself, with the verdict over all of them.

    watch where a fold has too few valid dates, unstable where one has no
    positive rank IC or no positive spread, else stable.
    """
    if folds < 2:
        raise ValueError("stability needs two folds or more")
    dates = panel.select("trade_date").distinct().withColumn("fold", F.ntile(folds).over(Window.orderBy("trade_date")))
    bucketed = with_bucket(complete_pairs(panel, x, y, groups), groups).join(F.broadcast(dates), "trade_date")
    daily = daily_ic(bucketed).join(long_short(bucketed, groups), "trade_date").join(F.broadcast(dates), "trade_date")
    each = daily.groupBy("fold").agg(
        F.count("ic").alias("n_dates"), F.avg("rank_ic").alias("rank_ic_mean"), ratio(F.avg("rank_ic"), F.stddev_samp("rank_ic")).alias("rank_ic_ir"), F.avg("long_short").alias("long_short_return"))
    spans = dates.groupBy("fold").agg(F.min("trade_date").alias("start_date"), F.max("trade_date").alias("end_date"))
    out = spans.join(each, "fold", "left").join(spread_turnover(bucketed, groups, "fold"), "fold", "left").fillna(0, ["n_dates"])
    whole = Window.partitionBy()  # one row a fold
    usable = F.count_if(F.col("n_dates") >= least_dates).over(whole)
    bad = F.coalesce(F.col("rank_ic_mean") <= 0, F.lit(True)) | F.coalesce(F.col("long_short_return") <= 0, F.lit(True))
    failing = F.count_if((F.col("n_dates") >= least_dates) & bad).over(whole)
    status = F.when(usable < folds, "watch").when(failing > 0, "unstable").otherwise("stable")
    reason = (
        F.when(usable < folds, F.format_string(f"only %d/{folds} folds have at least {least_dates} valid dates", usable))
        .when(failing > 0, F.format_string("%d/%d folds have non-positive RankIC or long-short return", failing, usable))
        .otherwise("all usable consecutive folds have positive RankIC and long-short return")
    )
    return out.withColumns({"status": status, "reason": reason})


# The limits of the screen.
REJECT_DATES, CANDIDATE_DATES, CANDIDATE_IC, CANDIDATE_IR, MOST_TURNOVER = 60, 120, 0.02, 0.15, 0.80


def screen(summary: DataFrame) -> DataFrame:
    """rejected, watch or candidate with the reasons.

    Rejected are factors of fewer than 60 dates or without a positive rank IC,
    ratio or spread; of the others those that miss a limit of the candidates
    (120 dates, rank IC 0.02, ratio 0.15, turnover 0.80) are watched.
    """
    positive = lambda c: F.coalesce(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) & (F.col(c) > 0), F.lit(False))
    rejections = F.array_compact(F.array(
        F.when(F.col("n_dates") < REJECT_DATES, F.format_string(f"only %d valid evaluation dates; need at least {REJECT_DATES}", "n_dates")),
        F.when(~positive("rank_ic_mean"), "RankIC must be finite and positive"),
        F.when(~positive("rank_ic_ir"), "RankIC IR must be finite and positive"),
        F.when(~positive("long_short_mean"), "long-short return must be finite and positive"),
    ))
    turnover_of = F.col("long_short_turnover")
    doubts = F.array_compact(F.array(
        F.when(F.col("n_dates") < CANDIDATE_DATES, F.format_string(f"only %d dates; need {CANDIDATE_DATES} for candidate status", "n_dates")),
        F.when(F.col("rank_ic_mean") < CANDIDATE_IC, F.format_string("RankIC %.4f is below 0.0200", "rank_ic_mean")),
        F.when(F.col("rank_ic_ir") < CANDIDATE_IR, F.format_string("RankIC IR %.4f is below 0.1500", "rank_ic_ir")),
        F.when(turnover_of.isNull() | F.isnan(turnover_of), "long-short turnover is unavailable").when(turnover_of > MOST_TURNOVER, F.format_string("long-short turnover %.2f exceeds 0.80", turnover_of)),
    ))
    good = F.array(F.lit("passes the pre-OOS factor screen; rolling OOS validation is still required"))
    return summary.withColumns({"_no": rejections, "_maybe": doubts}).withColumns({
        "status": F.when(F.size("_no") > 0, "rejected").when(F.size("_maybe") > 0, "watch").otherwise("candidate"),
        "reasons": F.when(F.size("_no") > 0, F.col("_no")).when(F.size("_maybe") > 0, F.col("_maybe")).otherwise(good),
    }).drop("_no", "_maybe")


def score_buckets(df: DataFrame, score: str, label: str, groups: int = 10) -> DataFrame:
    """Mean label by score bucket: by date first, then over dates."""
    return group_returns(with_bucket(complete_pairs(df, score, label, 1), groups))


def top_bottom(df: DataFrame, score: str, label: str, share: float = 0.2, least: int = 5) -> DataFrame:
    """Mean label of the best and the worst max(1, int(n * share)) rows of each date with enough rows."""
    pairs = complete_pairs(df, score, label, least)
    up, down = (Window.partitionBy("trade_date").orderBy(o, "symbol") for o in (F.asc("x"), F.desc("x")))
    n = F.count(F.lit(1)).over(Window.partitionBy("trade_date"))
    cut = F.greatest(F.lit(1), F.floor(n * share).cast("int"))
    ranked = pairs.withColumns({"low": F.row_number().over(up) <= cut, "high": F.row_number().over(down) <= cut})
    daily = ranked.groupBy("trade_date").agg(F.avg(F.when(F.col("high"), F.col("y"))).alias("top"), F.avg(F.when(F.col("low"), F.col("y"))).alias("bottom"))
    return daily.agg(F.avg("top").alias("top_return"), F.avg("bottom").alias("bottom_return"), (F.avg(F.col("top") - F.col("bottom"))).alias("spread"), F.count(F.lit(1)).alias("n_dates"))


def coverage_summary(df: DataFrame) -> DataFrame:
    """Fewest, median and most symbols of a date."""
    daily = df.groupBy("trade_date").agg(F.countDistinct("symbol").alias("n"))
    return daily.agg(F.min("n").alias("min_symbols"), F.median("n").alias("median_symbols"), F.max("n").alias("max_symbols"), F.count(F.lit(1)).alias("n_dates"))


#: So many factors of a security travel in one row: a task holds one date's rows of so many at a time.
TOGETHER = 18


def factor_rows(panel: DataFrame, names: list[str], *others: str) -> DataFrame:
    """trade_date, part, the other columns and xs: the values of up to TOGETHER factors (nulls fill up the last part); ``part`` numbers them."""
    parts = [names[k:k + TOGETHER] for k in range(0, len(names), TOGETHER)]
    values = [F.array(*(F.col(n).cast("double") for n in part), *[F.lit(None).cast("double")] * (len(parts[0]) - len(part))) for part in parts]
    cells = F.explode(F.array(*(F.struct(F.lit(k).alias("part"), x.alias("xs")) for k, x in enumerate(values)))).alias("cell")
    return panel.select("trade_date", *others, cells).select("trade_date", "cell.part", *others, "cell.xs")


def part_values(key: tuple, table: pa.Table, names: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The names of a part of ``factor_rows``, its values as a matrix and where they are not null."""
    own = names[key[1].as_py() * TOGETHER:][:TOGETHER]
    flat = pa.concat_arrays([c.flatten() for c in table["xs"].chunks])
    shape = (table.num_rows, min(TOGETHER, len(names)))
    return own, flat.to_numpy(zero_copy_only=False).reshape(shape), flat.is_valid().to_numpy(zero_copy_only=False).reshape(shape)


def _ranks(ordered: np.ndarray) -> np.ndarray:
    """Ranks of sorted values from 1, ties averaged."""
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    sizes = np.diff(np.append(starts, len(ordered)))
    return np.repeat(starts + (sizes + 1) / 2.0, sizes)


def _pearson(a: np.ndarray, b: np.ndarray) -> float | None:
    if len(a) < 2 or a.min() == a.max() or b.min() == b.max():
        return None
    a, b = a - a.mean(), b - b.mean()
    spread = np.sqrt(a @ a) * np.sqrt(b @ b)
    return None if spread == 0 else float(a @ b / spread)


_DAILY = "factor string, trade_date date, symbols string, ic double, rank_ic double, ls double, low_n long, high_n long, low array<long>, high array<long>"


def daily_by_factor(panel: DataFrame, names: list[str], label: str, least: int, groups: int) -> DataFrame:
    """A row for each factor and each date with ``least`` complete pairs: IC, rank IC, top minus bottom bucket, and the securities of both.

    Those are bits in the order of the date's symbols; ``symbols`` is a digest
    of that order. One task sorts a date's values of a few factors.
    """

    def each(key, table):
        by_symbol = pc.sort_indices(table["symbol"], null_placement="at_start").to_numpy()
        symbols = hashlib.sha256("\0".join(map(str, table["symbol"].take(pa.array(by_symbol)).to_pylist())).encode()).hexdigest()
        own, xs, _ = part_values(key, table, names)
        y = table["y"].to_numpy()[by_symbol]
        by_y, bits, rows = np.argsort(y, kind="stable"), np.zeros(-(-len(y) // 64) * 64, bool), []
        for j, name in enumerate(own):
            x = xs[by_symbol, j]
            kept = ~(np.isnan(x) | np.isnan(y))
            n = int(kept.sum())
            if n < max(least, 1):
                continue
            px, py = np.argsort(x, kind="stable"), by_y[kept[by_y]]
            px = px[kept[px]]
            rx, ry = np.empty(len(y)), np.empty(len(y))
            rx[px], ry[py] = _ranks(x[px]), _ranks(y[py])
            low, high = px[: n // groups], px[n * (groups - 1) // groups :]
            sides = []
            for side in (low, high):
                bits[:] = False
                bits[side] = True
                sides.append(np.packbits(bits).view(np.int64))
            with np.errstate(all="ignore"):
                spread = float(y[high].mean() - y[low].mean()) if len(low) else None
                rows.append((name, key[0].as_py(), symbols, _pearson(x[kept], y[kept]), _pearson(rx[kept], ry[kept]), spread, len(low), len(high), *sides))
        columns = list(zip(*rows, strict=True)) or [()] * 10
        kinds = (pa.string(), pa.date32(), pa.string(), *[pa.float64()] * 3, *[pa.int64()] * 2, *[pa.list_(pa.int64())] * 2)
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in _DAILY.split(", ")])

    return factor_rows(panel.withColumn("y", F.col(label).cast("double")), names, "symbol", "y").groupBy("trade_date", "part").applyInArrow(each, _DAILY)


def ic_by_factor(panel: DataFrame, names: list[str], label: str, least: int, groups: int = 5) -> DataFrame:
    """IC, rank IC, long-short mean and turnover of many factors of a dense panel at once, which is read once.

    The turnover is that of ``spread_turnover``; names that stay are bits that
    both dates have, so every date must hold the same symbols.
    """
    days = Window.partitionBy("factor").orderBy("trade_date")
    daily = daily_by_factor(panel, names, label, least, groups)
    other = F.lag("symbols").over(days) != F.col("symbols")
    turned = []
    for side in ("low", "high"):
        both = F.zip_with(side, F.lag(side).over(days), lambda a, b: F.bit_count(a.bitwiseAND(b)))
        m, before = F.col(f"{side}_n"), F.last(F.when(F.col(f"{side}_n") > 0, F.col(f"{side}_n")), ignorenulls=True).over(days.rowsBetween(Window.unboundedPreceding, -1))
        k = F.when(other, F.raise_error(F.lit("the panel is not dense: dates differ in their symbols"))).otherwise(F.aggregate(both, F.lit(0), lambda acc, x: acc + x))
        turned.append(F.when((m > 0) & before.isNotNull(), ((before - k) / before + (m - k) / m + k * F.abs(1.0 / m - 1.0 / before)) / 2).alias(f"{side}_t"))
    each = daily.select("factor", "ic", "rank_ic", "ls", *turned)
    return each.groupBy("factor").agg(
        F.avg("ic").alias("ic_mean"), F.avg("rank_ic").alias("rank_ic_mean"), ratio(F.avg("rank_ic"), F.stddev_samp("rank_ic")).alias("rank_ic_ir"), F.avg("ls").alias("long_short_mean"),
        F.count("ic").alias("n_dates"), ((F.coalesce(F.avg("low_t"), F.lit(0.0)) + F.coalesce(F.avg("high_t"), F.lit(0.0))) / 2).alias("long_short_turnover"))
