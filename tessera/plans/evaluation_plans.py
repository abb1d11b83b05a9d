"""Queries of preprocessing and factor evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.factors import REGISTRY, compute
from tessera.operators import evaluation as E
from tessera.operators.grid import dense_grid, forward_returns
from tessera.plans.factor_plans import FACTOR_SQL, SQL_BASE, SQL_WINDOWS
from tessera.sources.tables import bars

FACTOR, LABEL, GROUPS = "volatility_20d", "fwd_5d", 5


def _panel(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = (FACTOR,)) -> DataFrame:
    """Rounded factor and label on the grid."""
    grid = forward_returns(dense_grid(bars(spark, sf_dir)), (5,))
    panel = compute(grid, list(names), keep=("fwd_5d",))
    return panel.select("symbol", "trade_date", *((F.round(n, 8) + F.lit(0.0)).alias(n) for n in names), (F.round("fwd_5d", 8) + F.lit(0.0)).alias("fwd_5d"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.complete_pairs(_panel(spark, sf_dir), FACTOR, LABEL, GROUPS)


def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in df.dtypes))


def rank_ic_daily(spark, sf_dir):
    """IC and rank IC of each date."""
    return _round(E.daily_ic(_pairs(spark, sf_dir)))


def ic_summary(spark, sf_dir):
    """Means, deviations and ratios over dates."""
    return _round(E.ic_summary(E.daily_ic(_pairs(spark, sf_dir))))


def group_assignment(spark, sf_dir):
    """Bucket of each symbol and date."""
    return E.with_bucket(_pairs(spark, sf_dir), GROUPS).select("trade_date", "symbol", F.col("bucket").cast("long").alias("bucket"))


def group_returns(spark, sf_dir):
    """Mean return of each bucket."""
    return _round(E.group_returns(E.with_bucket(_pairs(spark, sf_dir), GROUPS)))


def long_short_daily(spark, sf_dir):
    """Top minus bottom of each date."""
    return _round(E.long_short(E.with_bucket(_pairs(spark, sf_dir), GROUPS), GROUPS))


def group_turnover(spark, sf_dir):
    """Turnover of each bucket."""
    return _round(E.turnover(E.with_bucket(_pairs(spark, sf_dir), GROUPS)))


def stability_folds(spark, sf_dir):
    """Three consecutive folds and the verdict over them."""
    return _round(E.stability(_panel(spark, sf_dir), FACTOR, LABEL, GROUPS))


def preprocess_factor(spark, sf_dir):
    """Winsorised value, z-score and percentile rank."""
    panel = compute(dense_grid(bars(spark, sf_dir)), [FACTOR])
    return _round(E.preprocess(panel.select("symbol", "trade_date", F.col(FACTOR).alias("x")), "x"))


COMPOSITE = {"volatility_20d": (0.5, -1), "momentum_20d": (0.3, 1), "amount_stability_20d": (0.2, 1)}


def composite_factor(spark, sf_dir):
    """Weighted, oriented z-scores of three factors."""
    panel = _panel(spark, sf_dir, tuple(COMPOSITE))
    return _round(E.composite(panel, COMPOSITE).select("symbol", "trade_date", "composite"))


def factor_screening(spark, sf_dir):
    """All factors: summary, spread, reasons and status."""
    names = list(REGISTRY)
    out = E.screen(E.ic_by_factor(_panel(spark, sf_dir, tuple(names)), names, LABEL, GROUPS))
    return _round(out.select("factor", "ic_mean", "rank_ic_mean", "rank_ic_ir", "long_short_mean", "long_short_turnover", "n_dates", F.array_join("reasons", "; ").alias("reasons"), "status"))


def score_buckets(spark, sf_dir):
    """Ten buckets of a score."""
    return _round(E.score_buckets(_panel(spark, sf_dir), FACTOR, LABEL, 10))


def top_bottom_return(spark, sf_dir):
    """Best and worst fifth."""
    return _round(E.top_bottom(_panel(spark, sf_dir), FACTOR, LABEL))


def coverage_summary(spark, sf_dir):
    """Symbols per date."""
    return _round(E.coverage_summary(_pairs(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (
    rank_ic_daily, ic_summary, group_assignment, group_returns, long_short_daily, group_turnover, stability_folds, preprocess_factor,
    composite_factor, factor_screening, score_buckets, top_bottom_return, coverage_summary)}

_LABEL_SQL = "round(lead(close, 6) OVER w / nullif(lead(close, 1) OVER w, 0) - 1, 8) + 0.0"
_PANEL = f"{SQL_BASE}, panel AS (SELECT symbol, trade_date, round({FACTOR_SQL[FACTOR]}, 8) + 0.0 AS x, {_LABEL_SQL} AS y FROM b3 {SQL_WINDOWS})"


def _pairs_sql(least: int) -> str:
    return f"{_PANEL}, pairs AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY trade_date) AS n FROM panel WHERE x IS NOT NULL AND y IS NOT NULL) WHERE n >= {least})"


_PAIRS = _pairs_sql(GROUPS)
_RANKED = f"""{_PAIRS}, ranked AS (SELECT *,
  rank() OVER (PARTITION BY trade_date ORDER BY x) + (count(*) OVER (PARTITION BY trade_date, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY trade_date ORDER BY y) + (count(*) OVER (PARTITION BY trade_date, y) - 1) / 2.0 AS ry FROM pairs),
daily AS (SELECT trade_date, count(*) AS n, covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0) AS ic,
  covar_samp(rx, ry) / nullif(stddev_samp(rx) * stddev_samp(ry), 0) AS rank_ic FROM ranked GROUP BY 1)"""


def _buckets(groups: int, pairs: str = _PAIRS) -> str:
    return f"""{pairs}, b AS (SELECT trade_date, symbol, x, y, CAST(greatest(1, least({groups}, ceil(row_number() OVER (PARTITION BY trade_date ORDER BY x, symbol)
  * {groups} / CAST(count(*) OVER (PARTITION BY trade_date) AS DOUBLE)))) AS BIGINT) AS bucket FROM pairs)"""


_B5 = _buckets(GROUPS)
_LS = "ls AS (SELECT trade_date, avg(y) FILTER (bucket = 5) - avg(y) FILTER (bucket = 1) AS long_short FROM b GROUP BY 1)"
_GROUP = "SELECT bucket, round(avg(m), 6) + 0.0 AS mean_return, count(*) AS n_dates FROM (SELECT trade_date, bucket, avg(y) AS m FROM b GROUP BY 1, 2) GROUP BY 1"


def _turnover_sql(key: str, source: str, bucket: str) -> str:
    """CTEs that end in ``tt``: key, t, the mean of the top and bottom bucket's turnover from weight changes."""
    return f"""td AS (SELECT {key}, trade_date, row_number() OVER (PARTITION BY {key} ORDER BY trade_date) AS i FROM (SELECT DISTINCT {key}, trade_date FROM {source})),
tw AS (SELECT {key}, {bucket} AS g, symbol, i, 1.0::DOUBLE / count(*) OVER (PARTITION BY {key}, trade_date, {bucket}) AS w FROM {source} JOIN td USING ({key}, trade_date)),
tm AS (SELECT * FROM tw UNION ALL SELECT {key}, g, symbol, i + 1, -w FROM tw), tc AS (SELECT {key}, g, i, symbol, sum(w) AS dw FROM tm WHERE i >= 2 GROUP BY ALL),
te AS (SELECT {key}, max(i) AS last FROM td GROUP BY 1), ts AS (SELECT {key}, g, i, sum(abs(dw)) / 2 AS t FROM tc JOIN te USING ({key}) WHERE i <= last GROUP BY ALL),
tt AS (SELECT {key}, (coalesce(avg(t) FILTER (g = 1), 0) + coalesce(avg(t) FILTER (g = 5), 0)) / 2 AS t FROM td LEFT JOIN ts USING ({key}) GROUP BY 1)"""


def _mad(table: str, x: str, out: str) -> str:
    """CTEs that winsorise x of a table and add its z-score."""
    return f"""{out}1 AS (SELECT *, median({x}) OVER (PARTITION BY trade_date) AS m FROM {table}),
{out}2 AS (SELECT *, median(abs({x} - m)) OVER (PARTITION BY trade_date) AS d FROM {out}1),
{out}3 AS (SELECT * EXCLUDE (m, d, {x}), CASE WHEN {x} IS NULL OR d = 0 THEN {x} ELSE greatest(m - d * 1.4826 * 3, least(m + d * 1.4826 * 3, {x})) END AS {x} FROM {out}2),
{out}4 AS (SELECT *, median({x}) OVER (PARTITION BY trade_date) AS m FROM {out}3),
{out}5 AS (SELECT *, median(abs({x} - m)) OVER (PARTITION BY trade_date) AS d FROM {out}4),
{out} AS (SELECT * EXCLUDE (m, d), CASE WHEN d = 0 THEN {x} - m ELSE ({x} - m) / (d * 1.4826) END AS z_{x} FROM {out}5)"""


_SCREEN_CELLS = " UNION ALL ".join(f"SELECT '{n}' AS factor, trade_date, symbol, {n} AS x, y FROM wide" for n in REGISTRY)
ORACLE = {
    "rank_ic_daily": f"WITH {_RANKED} SELECT trade_date, n, round(ic, 6) + 0.0 AS ic, round(rank_ic, 6) + 0.0 AS rank_ic FROM daily",
    "ic_summary": f"WITH {_RANKED} SELECT " + ", ".join(
        f"round(avg({c}), 6) + 0.0 AS {c}_mean, round(stddev_samp({c}), 6) + 0.0 AS {c}_std, round(avg({c}) / nullif(stddev_samp({c}), 0), 6) + 0.0 AS {c}_ir" for c in ("ic", "rank_ic")
    ) + ", count(*) AS n_dates FROM daily",
    "group_assignment": f"WITH {_B5} SELECT trade_date, symbol, bucket FROM b",
    "group_returns": f"WITH {_B5} {_GROUP}",
    "long_short_daily": f"WITH {_B5}, {_LS} SELECT trade_date, round(long_short, 6) + 0.0 AS long_short FROM ls",
    "group_turnover": f"""WITH {_B5}, dates AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS idx FROM (SELECT DISTINCT trade_date FROM b)),
h AS (SELECT bucket, symbol, idx, 1.0::DOUBLE / count(*) OVER (PARTITION BY b.trade_date, bucket) AS w FROM b JOIN dates USING (trade_date)),
m AS (SELECT * FROM h UNION ALL SELECT bucket, symbol, idx + 1, -w FROM h),
c AS (SELECT bucket, idx, symbol, sum(w) AS dw FROM m WHERE idx BETWEEN 2 AND (SELECT max(idx) FROM dates) GROUP BY ALL),
t AS (SELECT bucket, idx, sum(abs(dw)) / 2 AS t FROM c GROUP BY ALL) SELECT bucket, round(avg(t), 6) + 0.0 AS turnover FROM t GROUP BY 1""",
    "stability_folds": f"""WITH {_RANKED}, {_B5[len(_PAIRS) + 2:]}, {_LS}, f AS (SELECT trade_date, ntile(3) OVER (ORDER BY trade_date) AS fold FROM (SELECT DISTINCT trade_date FROM panel)),
{_turnover_sql('fold', 'b JOIN f USING (trade_date)', 'bucket')},
a AS (SELECT fold, count(ic) AS n_dates, avg(rank_ic) AS r, avg(rank_ic) / nullif(stddev_samp(rank_ic), 0) AS ir, avg(long_short) AS l FROM f JOIN daily USING (trade_date) JOIN ls USING (trade_date) GROUP BY 1),
e AS (SELECT sp.*, coalesce(n_dates, 0) AS n_dates, r, ir, l, t FROM (SELECT fold, min(trade_date) AS start_date, max(trade_date) AS end_date FROM f GROUP BY 1) sp LEFT JOIN a USING (fold) LEFT JOIN tt USING (fold)),
v AS (SELECT *, count(*) FILTER (n_dates >= 20) OVER () AS u, count(*) FILTER (n_dates >= 20 AND (r IS NULL OR r <= 0 OR l IS NULL OR l <= 0)) OVER () AS bad FROM e)
SELECT fold, start_date, end_date, n_dates, round(r, 6) + 0.0 AS rank_ic_mean, round(ir, 6) + 0.0 AS rank_ic_ir, round(l, 6) + 0.0 AS long_short_return, round(t, 6) + 0.0 AS long_short_turnover,
  CASE WHEN u < 3 THEN 'watch' WHEN bad > 0 THEN 'unstable' ELSE 'stable' END AS status,
  CASE WHEN u < 3 THEN 'only ' || u || '/3 folds have at least 20 valid dates' WHEN bad > 0 THEN bad || '/' || u || ' folds have non-positive RankIC or long-short return'
    ELSE 'all usable consecutive folds have positive RankIC and long-short return' END AS reason FROM v""",
    "preprocess_factor": f"""WITH {SQL_BASE}, px AS (SELECT symbol, trade_date, {FACTOR_SQL[FACTOR]} AS x FROM b3 {SQL_WINDOWS}), {_mad('px', 'x', 'p')}
SELECT symbol, trade_date, round(x, 6) + 0.0 AS x, round(z_x, 6) + 0.0 AS z, round(CASE WHEN x IS NOT NULL THEN
  (rank() OVER (PARTITION BY trade_date, x IS NULL ORDER BY x) + (count(*) OVER (PARTITION BY trade_date, x) - 1) / 2.0) / count(x) OVER (PARTITION BY trade_date) END, 6) + 0.0 AS pct FROM p""",
    "composite_factor": f"""WITH {SQL_BASE}, c0 AS (SELECT symbol, trade_date, {', '.join(f'round({FACTOR_SQL[n]}, 8) + 0.0 AS {n}' for n in COMPOSITE)} FROM b3 {SQL_WINDOWS}),
{_mad('c0', 'volatility_20d', 'c1x')}, {_mad('c1x', 'momentum_20d', 'c2x')}, {_mad('c2x', 'amount_stability_20d', 'c3x')}
SELECT symbol, trade_date, round(({' + '.join(f'z_{n} * {w * d}' for n, (w, d) in COMPOSITE.items())}) / 1.0, 6) + 0.0 AS composite FROM c3x""",
    "factor_screening": f"""WITH {SQL_BASE}, wide AS (SELECT symbol, trade_date, {', '.join(f'round({FACTOR_SQL[n]}, 8) + 0.0 AS {n}' for n in REGISTRY)}, {_LABEL_SQL} AS y FROM b3 {SQL_WINDOWS}),
cells AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY factor, trade_date) AS n FROM ({_SCREEN_CELLS}) WHERE x IS NOT NULL AND y IS NOT NULL) WHERE n >= {GROUPS}),
r AS (SELECT *, rank() OVER (PARTITION BY factor, trade_date ORDER BY x) + (count(*) OVER (PARTITION BY factor, trade_date, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY factor, trade_date ORDER BY y) + (count(*) OVER (PARTITION BY factor, trade_date, y) - 1) / 2.0 AS ry,
  greatest(1, least(5, ceil(row_number() OVER (PARTITION BY factor, trade_date ORDER BY x, symbol) * 5 / CAST(n AS DOUBLE)))) AS bk FROM cells),
d AS (SELECT factor, trade_date, covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0) AS ic, covar_samp(rx, ry) / nullif(stddev_samp(rx) * stddev_samp(ry), 0) AS rank_ic,
  avg(y) FILTER (bk = 5) - avg(y) FILTER (bk = 1) AS ls FROM r GROUP BY 1, 2),
{_turnover_sql('factor', 'r', 'bk')},
s AS (SELECT factor, avg(ls) AS l, avg(ic) AS a, avg(rank_ic) AS b, avg(rank_ic) / nullif(stddev_samp(rank_ic), 0) AS c, count(ic) AS n_dates FROM d GROUP BY 1),
q AS (SELECT *, list_filter([CASE WHEN n_dates < 60 THEN 'only ' || n_dates || ' valid evaluation dates; need at least 60' END, CASE WHEN NOT coalesce(b > 0, false) THEN 'RankIC must be finite and positive' END,
    CASE WHEN NOT coalesce(c > 0, false) THEN 'RankIC IR must be finite and positive' END, CASE WHEN NOT coalesce(l > 0, false) THEN 'long-short return must be finite and positive' END], lambda v: v IS NOT NULL) AS no,
  list_filter([CASE WHEN n_dates < 120 THEN 'only ' || n_dates || ' dates; need 120 for candidate status' END, CASE WHEN b < 0.02 THEN printf('RankIC %.4f is below 0.0200', b) END,
    CASE WHEN c < 0.15 THEN printf('RankIC IR %.4f is below 0.1500', c) END, CASE WHEN t IS NULL THEN 'long-short turnover is unavailable' WHEN t > 0.80 THEN printf('long-short turnover %.2f exceeds 0.80', t) END], lambda v: v IS NOT NULL) AS maybe FROM s JOIN tt USING (factor))
SELECT factor, round(a, 6) + 0.0 AS ic_mean, round(b, 6) + 0.0 AS rank_ic_mean, round(c, 6) + 0.0 AS rank_ic_ir, round(l, 6) + 0.0 AS long_short_mean, round(t, 6) + 0.0 AS long_short_turnover, n_dates,
  CASE WHEN len(no) > 0 THEN array_to_string(no, '; ') WHEN len(maybe) > 0 THEN array_to_string(maybe, '; ') ELSE 'passes the pre-OOS factor screen; rolling OOS validation is still required' END AS reasons,
  CASE WHEN len(no) > 0 THEN 'rejected' WHEN len(maybe) > 0 THEN 'watch' ELSE 'candidate' END AS status FROM q""",
    "score_buckets": f"WITH {_buckets(10, _pairs_sql(1))} {_GROUP}",
    "top_bottom_return": f"""WITH {_PAIRS}, r AS (SELECT trade_date, y, row_number() OVER (PARTITION BY trade_date ORDER BY x, symbol) AS lo,
  row_number() OVER (PARTITION BY trade_date ORDER BY x DESC, symbol) AS hi, greatest(1, floor(n * 0.2)) AS cut FROM pairs),
d AS (SELECT trade_date, avg(y) FILTER (hi <= cut) AS t, avg(y) FILTER (lo <= cut) AS b FROM r GROUP BY 1)
SELECT round(avg(t), 6) + 0.0 AS top_return, round(avg(b), 6) + 0.0 AS bottom_return, round(avg(t - b), 6) + 0.0 AS spread, count(*) AS n_dates FROM d""",
    "coverage_summary": f"""WITH {_PAIRS}, d AS (SELECT trade_date, count(DISTINCT symbol) AS n FROM pairs GROUP BY 1)
SELECT min(n) AS min_symbols, round(median(n), 6) + 0.0 AS median_symbols, max(n) AS max_symbols, count(*) AS n_dates FROM d""",
}
