"""Strategy, risk, execution and validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import execution as X
from tessera.operators import strategy as S
from tessera.operators.grid import dense_grid
from tessera.plans.evaluation_plans import _round
from tessera.plans.factor_plans import SQL_GRID
from tessera.sources.tables import SQL_BARS, SQL_INDEX, bars, index_bars

EVERY, AMOUNT, PRICE = 5, 50_000.0, 5.0
ALL = S.catalogue(AMOUNT, PRICE, calm_drawdown=0.95, up_ratio=0.4, inverse_drawdown=0.9, oversold_rsi=45.0, oversold_z=0.8, most_index_momentum=0.05)


def _ranks(spark, sf_dir, name):
    b = bars(spark, sf_dir)
    rows, index = S.features(b), index_bars(spark, sf_dir)
    decisions = S.decision_rows(S.with_beta(rows, index) if ALL[name].relative else rows, b, EVERY)
    return S.ranked(S.with_index_momentum(decisions, index) if ALL[name].silent != "false" else decisions, ALL[name])


def ranks_query(name):
    """decision_date, symbol, score, rank of a strategy's candidates."""

    def query(spark, sf_dir):
        return _round(_ranks(spark, sf_dir, name).select("decision_date", "symbol", "score", "rank"))

    return query


def weights_query(name):
    """decision_date, symbol, weight of a strategy that holds no state."""

    def query(spark, sf_dir):
        return _round(S.target_weights(_ranks(spark, sf_dir, name), ALL[name]))

    return query


def _weights(spark, sf_dir, name="momentum_rank"):
    return S.target_weights(_ranks(spark, sf_dir, name), ALL[name])


def risk_gate(spark, sf_dir):
    """The risk engine after a strategy, with a block list."""
    w = _weights(spark, sf_dir, "moving_average")
    blocked = w.where(F.col("symbol").cast("int") % 7 == 0).select("decision_date", "symbol")
    return _round(S.risk_gate(w, blocked, 0.2, 0.95, 12))


def frictionless_returns(spark, sf_dir):
    """Gross returns of lagged weights."""
    return _round(S.frictionless(_weights(spark, sf_dir), dense_grid(bars(spark, sf_dir))))


def downside_beta(spark, sf_dir):
    """Beta on down days."""
    return _round(S.downside_beta(bars(spark, sf_dir), index_bars(spark, sf_dir)))


def _index_curve(spark, sf_dir):
    b = index_bars(spark, sf_dir)
    return b.select(F.lit("index").alias("run_id"), "trade_date", F.col("close").alias("equity"), F.lit("equity").alias("kind"), F.lit(0.0).alias("cash"), F.lit(0.0).alias("position_value"))


def drawdown_curve(spark, sf_dir):
    """Drawdown of the index."""
    return X.equity_curve(_index_curve(spark, sf_dir)).select("trade_date", "equity", "drawdown")


def backtest_metrics(spark, sf_dir):
    """Metrics of a curve (the index as a run of its own)."""
    return X.metrics(X.equity_curve(_index_curve(spark, sf_dir)), 1000.0, index_bars(spark, sf_dir))


def benchmark_curve(spark, sf_dir):
    """The index rebased to the initial cash."""
    b = index_bars(spark, sf_dir)
    first = b.agg(F.min_by("close", "trade_date").alias("f"))
    return b.join(F.broadcast(first)).select("trade_date", F.round(F.col("close") / F.col("f") * 1_000_000, 2).alias("equity"), F.round(F.col("close") / F.col("f") - 1, 6).alias("return"))


def monthly_report(spark, sf_dir):
    """Monthly returns of the index curve against one symbol with gaps."""
    curve = X.equity_curve(_index_curve(spark, sf_dir))
    return _round(X.monthly_report(curve, bars(spark, sf_dir).where("symbol = '000001'")))


def monthly_summary(spark, sf_dir):
    """Counts, mean, worst and best of the monthly excess."""
    return _round(X.monthly_summary(monthly_report(spark, sf_dir)))


def walk_forward_windows(spark, sf_dir):
    """Windows over the date axis."""
    return _round(X.walk_forward_windows(bars(spark, sf_dir), 60, 20, 40))


_STATELESS = [n for n, s in ALL.items() if not s.buffered]
QUERIES = (
    {f"ranks_{n}": ranks_query(n) for n in ALL} | {f"weights_{n}": weights_query(n) for n in _STATELESS}
    | {f.__name__: f for f in (risk_gate, frictionless_returns, downside_beta, drawdown_curve, backtest_metrics, benchmark_curve, monthly_report, monthly_summary, walk_forward_windows)})


def _w(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _lag(n: int) -> str:
    return f"lag(close, {n}) OVER (PARTITION BY symbol ORDER BY trade_date)"


_GAIN, _LOSS = (f"avg(greatest({s}d, 0)) OVER {_w(14)}" for s in ("", "-"))
_FEATURES = f"""{SQL_BARS}, f1 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date) AS rn, {_lag(1)} AS prev, ln(CASE WHEN amount > 0 THEN amount END) AS la FROM bars),
f2 AS (SELECT *, close / nullif(prev, 0) - 1 AS r, close - prev AS d, la - lag(la) OVER (PARTITION BY symbol ORDER BY trade_date) AS dla,
  greatest(high - low, coalesce(abs(high - prev), 0), coalesce(abs(low - prev), 0)) AS tr FROM f1),
f3 AS (SELECT *, avg(close) OVER {_w(20)} AS ma20, avg(close) OVER {_w(60)} AS ma60, avg(close) OVER {_w(120)} AS ma120, avg(amount) OVER {_w(5)} AS amt5, avg(amount) OVER {_w(20)} AS amt20,
  {_lag(5)} / nullif({_lag(65)}, 0) - 1 AS mom60s5, close / nullif({_lag(60)}, 0) - 1 AS mom60, close / nullif({_lag(5)}, 0) - 1 AS ret5, {_lag(5)} / nullif(close, 0) - 1 AS rev5,
  (close - avg(close) OVER {_w(20)}) / nullif(stddev_samp(close) OVER {_w(20)}, 0) AS z20, stddev_samp(r) OVER {_w(20)} AS vola20,
  avg(r) OVER {_w(20)} / nullif(stddev_samp(r) OVER {_w(20)}, 0) AS sharpe20, stddev_samp(r) OVER {_w(19)} AS vol19, avg(CASE WHEN r > 0 THEN 1.0::DOUBLE ELSE 0 END) OVER {_w(19)} AS up19,
  close / nullif(max(close) OVER {_w(20)}, 0) AS near20, avg(volume) OVER {_w(5)} / nullif(avg(volume) OVER {_w(50)}, 0) AS volx,
  avg(amount) OVER {_w(20)} / nullif(stddev_samp(amount) OVER {_w(20)}, 0) AS stab20, stddev_samp(dla) OVER {_w(20)} AS lav20, quantile_cont(r, 0.05) OVER {_w(20)} AS tail20,
  list_min(list_transform(list(close) OVER {_w(60)}, lambda x, k: x / list_max((list(close) OVER {_w(60)})[1:k]) - 1)) AS dd60, CASE WHEN rn >= 14 THEN avg(tr) OVER {_w(14)} END AS atr14,
  CASE WHEN {_LOSS} = 0 AND {_GAIN} > 0 THEN 100 WHEN {_LOSS} = 0 AND {_GAIN} = 0 THEN 50 ELSE 100 - 100 / (1 + {_GAIN} / nullif({_LOSS}, 0)) END AS rsi14, {_lag(20)} / nullif(close, 0) - 1 AS rev20 FROM f2),
f4 AS (SELECT *, close / nullif(ma60, 0) AS trend60, rev20 / nullif(vola20, 0) AS lvr20, list_filter(list(atr14) OVER {_w(20)}, lambda x: x IS NOT NULL) AS recent FROM f3),
feat AS (SELECT *, CASE WHEN len(recent) >= 2 THEN len(list_filter(recent, lambda x: x <= atr14)) / CAST(len(recent) AS DOUBLE) END AS atr_rank FROM f4),
axis AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS idx FROM (SELECT DISTINCT trade_date FROM bars)),
decided AS (SELECT * EXCLUDE (k) FROM (SELECT a.trade_date AS decision_date, feat.*, row_number() OVER (PARTITION BY a.trade_date, symbol ORDER BY feat.trade_date DESC) AS k
  FROM axis a JOIN feat ON feat.trade_date <= a.trade_date WHERE a.idx % {EVERY} = 0) WHERE k = 1)"""


def _ranks_sql(s: S.Strategy) -> str:
    """CTEs that end in ``ranks``."""
    total = sum(w for w, _ in s.factors.values())
    if s.relative:
        name, weight, limit = s.relative
        pct = lambda k, sign: f"CASE WHEN count(*) OVER d <= 1 THEN 1.0 ELSE {'' if sign > 0 else '1 - '}(rank() OVER (PARTITION BY decision_date ORDER BY {k}) + (count(*) OVER (PARTITION BY decision_date, {k}) - 1) / 2.0 - 1) / nullif(CAST(count(*) OVER d AS DOUBLE) - 1, 0) END"
        marks = ", ".join(f"{pct(k, sign)} AS p_{k}" for k, (_, sign) in s.factors.items())
        marks += f""", CASE WHEN {name} IS NULL THEN 0 WHEN count({name}) OVER d <= 1 THEN 1 ELSE 1 - (rank() OVER (PARTITION BY decision_date, {name} IS NULL ORDER BY {name}) + (count(*) OVER (PARTITION BY decision_date, {name}) - 1) / 2.0 - 1)
  / nullif(CAST(count({name}) OVER d AS DOUBLE) - 1, 0) END AS p_rel, count({name}) OVER d AS n_rel"""
        alone = " + ".join(f"p_{k} * {w!r}" for k, (w, _) in s.factors.items())
        score = f"round(CASE WHEN n_rel > 0 THEN p_rel * {weight} + p_trend60 * 0.35 + p_vol19 * 0.25 + p_volx * 0.15 ELSE {alone} END, 9)"
        features = f"""{_FEATURES}, {SQL_INDEX}, ix AS (SELECT trade_date, close / lag(close) OVER (ORDER BY trade_date) - 1 AS m FROM index_bars),
own AS (SELECT symbol, trade_date, r, m, row_number() OVER (PARTITION BY symbol ORDER BY trade_date) AS j FROM feat JOIN ix USING (trade_date) WHERE r IS NOT NULL AND m IS NOT NULL),
bt AS (SELECT a.symbol, a.trade_date, CASE WHEN count(*) >= 5 AND var_samp(b.m) >= 1e-12 THEN covar_samp(b.r, b.m) / var_samp(b.m) END AS {name} FROM own a JOIN own b ON a.symbol = b.symbol AND b.j BETWEEN a.j - 59 AND a.j AND b.m < 0 GROUP BY 1, 2),
rated AS (SELECT d.*, bt.{name} FROM decided d LEFT JOIN bt USING (symbol, trade_date))"""
        return f"""{features}, gated AS (SELECT * FROM rated WHERE {s.gate} AND ({name} IS NULL OR {name} <= {limit})), marked AS (SELECT *, {marks} FROM gated WINDOW d AS (PARTITION BY decision_date)),
ranks AS (SELECT decision_date, symbol, CAST({score} AS DOUBLE) AS score, row_number() OVER (PARTITION BY decision_date ORDER BY {score} DESC, symbol) AS rank, vol19 FROM marked)"""
    quiet = ""
    if s.silent != "false":
        quiet = f" AND NOT (coalesce((SELECT k.index_momentum FROM km k WHERE k.trade_date = decided.decision_date), 0) > {s.silent.split('> ')[1]})"
    if s.factors:
        marks = ", ".join(f"CASE WHEN count(*) OVER d <= 1 THEN 1.0 ELSE {'' if sign > 0 else '1 - '}(rank() OVER (PARTITION BY decision_date ORDER BY {k}) + (count(*) OVER (PARTITION BY decision_date, {k}) - 1) / 2.0 - 1) / nullif(CAST(count(*) OVER d AS DOUBLE) - 1, 0) END AS p_{k}" for k, (_, sign) in s.factors.items())
        score = f"round({' + '.join(f'p_{k} * {w / total!r}' for k, (w, _) in s.factors.items())}, 9)"
    else:
        marks, score = "1 AS one", "0.0" if s.order == "symbol" else s.order
    by = f"{score} {'ASC' if s.ascending else 'DESC'}, {f'{s.then} DESC, ' if s.then else ''}symbol"
    index = f""", {SQL_INDEX}, km AS (SELECT trade_date, close / nullif(lag(close, {S.INDEX_WINDOW}) OVER (ORDER BY trade_date), 0) - 1 AS index_momentum FROM index_bars)""" if quiet else ""
    return f"""{_FEATURES}{index}, gated AS (SELECT * FROM decided WHERE {s.gate}{quiet}), marked AS (SELECT *, {marks} FROM gated WINDOW d AS (PARTITION BY decision_date)),
ranks AS (SELECT decision_date, symbol, CAST({score} AS DOUBLE) AS score, row_number() OVER (PARTITION BY decision_date ORDER BY {by}) AS rank, vol19 FROM marked)"""


def _weights_sql(s: S.Strategy) -> str:
    """CTEs that end in ``weights``."""
    chosen = f"{_ranks_sql(s)}, chosen AS (SELECT * FROM ranks WHERE rank <= {s.top_n})"
    if s.weighting == "full":
        return f"{chosen}, weights AS (SELECT decision_date, symbol, {s.cap}::DOUBLE AS weight FROM chosen)"
    if s.weighting == "inverse_vol":
        return f"""{chosen}, iv AS (SELECT *, 1.0 / (greatest(vol19, 1e-8) + 1e-8) AS i FROM chosen), cw AS (SELECT *, least(i / sum(i) OVER (PARTITION BY decision_date), {s.cap}) AS w FROM iv),
weights AS (SELECT decision_date, symbol, CASE WHEN sum(w) OVER d > {s.gross} THEN w * {s.gross} / sum(w) OVER d ELSE w END AS weight FROM cw WINDOW d AS (PARTITION BY decision_date))"""
    return f"{chosen}, weights AS (SELECT decision_date, symbol, least({s.cap}::DOUBLE, {s.gross}::DOUBLE / count(*) OVER (PARTITION BY decision_date)) AS weight FROM chosen)"


_CURVE = f"WITH {SQL_BARS}, {SQL_INDEX}, curve AS (SELECT trade_date, close AS equity, round(close / max(close) OVER (ORDER BY trade_date) - 1, 6) AS drawdown FROM index_bars)"
_MONTHS = f"""{_CURVE}, j AS (SELECT c.*, last_value(b.close IGNORE NULLS) OVER (ORDER BY c.trade_date) AS b FROM curve c LEFT JOIN bars b ON b.trade_date = c.trade_date AND b.symbol = '000001'),
m AS (SELECT strftime(trade_date, '%Y-%m') AS month, arg_max(equity, trade_date) / arg_min(equity, trade_date) - 1 AS r,
  (arg_max(b, trade_date) FILTER (b IS NOT NULL)) / (arg_min(b, trade_date) FILTER (b IS NOT NULL)) - 1 AS br, min(drawdown) AS dd FROM j GROUP BY 1),
months AS (SELECT month, round(r, 6) + 0.0 AS "return", round(br, 6) + 0.0 AS benchmark_return, round(r - br, 6) + 0.0 AS excess_return, round(dd, 6) + 0.0 AS max_drawdown FROM m)"""
ORACLE = {f"ranks_{n}": f"WITH {_ranks_sql(s)} SELECT decision_date, symbol, round(score, 6) + 0.0 AS score, rank FROM ranks" for n, s in ALL.items()}
ORACLE |= {f"weights_{n}": f"WITH {_weights_sql(ALL[n])} SELECT decision_date, symbol, round(weight, 6) + 0.0 AS weight FROM weights" for n in _STATELESS}
ORACLE |= {
    "risk_gate": f"""WITH {_weights_sql(ALL['moving_average'])}, a AS (SELECT decision_date, symbol, least(weight, 0.2) AS w, row_number() OVER (PARTITION BY decision_date ORDER BY least(weight, 0.2) DESC, symbol) AS k FROM weights WHERE CAST(symbol AS INT) % 7 <> 0),
b AS (SELECT *, sum(w) OVER (PARTITION BY decision_date) AS s FROM a WHERE k <= 12) SELECT decision_date, symbol, round(CASE WHEN s > 0.95 THEN w * 0.95 / s ELSE w END, 6) + 0.0 AS weight FROM b""",
    "frictionless_returns": f"""WITH {_weights_sql(ALL['momentum_rank'])}, grid AS {SQL_GRID[SQL_GRID.index('grid AS') + 8:]}, d AS (SELECT decision_date, idx, lead(idx) OVER (ORDER BY idx) AS until FROM (SELECT DISTINCT decision_date FROM weights) JOIN axis ON trade_date = decision_date),
r AS (SELECT symbol, trade_date, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY trade_date), 0) - 1 AS r FROM grid)
SELECT r.trade_date, round(sum(weight * coalesce(r.r, 0)), 6) + 0.0 AS gross_return FROM weights JOIN d USING (decision_date) JOIN r ON r.symbol = weights.symbol JOIN axis a ON a.trade_date = r.trade_date
WHERE a.idx >= d.idx + 2 AND (d.until IS NULL OR a.idx < d.until + 2) GROUP BY 1""",
    "downside_beta": f"""WITH {SQL_BARS}, {SQL_INDEX}, o AS (SELECT symbol, trade_date, close / nullif({_lag(1)}, 0) - 1 AS r FROM bars), m AS (SELECT trade_date, close / lag(close) OVER (ORDER BY trade_date) - 1 AS m FROM index_bars),
b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS k FROM o JOIN m USING (trade_date) WHERE r IS NOT NULL AND m IS NOT NULL)
SELECT symbol, round(CASE WHEN count(*) >= 5 AND var_samp(m) >= 1e-12 THEN covar_samp(r, m) / var_samp(m) END, 6) + 0.0 AS beta FROM b WHERE k <= 60 AND m < 0 GROUP BY 1""",
    "drawdown_curve": f"{_CURVE} SELECT * FROM curve",
    "backtest_metrics": f"""{_CURVE}, r AS (SELECT *, equity / lag(equity) OVER (ORDER BY trade_date) - 1 AS r FROM curve),
a AS (SELECT arg_max(equity, trade_date) AS f, arg_min(equity, trade_date) AS f0, count(*) AS n, min(drawdown) AS dd, avg(r) AS m, stddev_samp(r) AS s FROM r)
SELECT 'index' AS run_id, f AS final_equity, dd AS max_drawdown, round(f / 1000 - 1, 6) AS total_return, round(pow(f / 1000, 252 / CAST(n AS DOUBLE)) - 1, 6) AS annual_return,
round(m / s * sqrt(252), 6) AS sharpe, round(f / f0 - 1, 6) AS benchmark_return, round(round(f / 1000 - 1, 6) - round(f / f0 - 1, 6), 6) AS excess_return FROM a""",
    "benchmark_curve": f"WITH {SQL_INDEX} SELECT trade_date, round(close / first_value(close) OVER w * 1000000, 2) AS equity, round(close / first_value(close) OVER w - 1, 6) AS \"return\" FROM index_bars WINDOW w AS (ORDER BY trade_date)",
    "monthly_report": f"{_MONTHS} SELECT * FROM months",
    "monthly_summary": f"""{_MONTHS} SELECT count(*) AS months, count(*) FILTER (excess_return > 0) AS positive_excess_months, count(*) FILTER (excess_return < 0) AS negative_excess_months,
round(avg(excess_return), 6) + 0.0 AS mean_monthly_excess, round(min(excess_return), 6) + 0.0 AS worst_monthly_excess, round(max(excess_return), 6) + 0.0 AS best_monthly_excess FROM months""",
    "walk_forward_windows": f"""WITH {SQL_BARS}, a AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS idx FROM (SELECT DISTINCT trade_date FROM bars)), n AS (SELECT count(*) AS n FROM a),
w AS (SELECT unnest(range(60, n - 20 + 1, 20)) AS s FROM n) SELECT CAST((s - 60) / 20 AS BIGINT) AS window_id, (SELECT trade_date FROM a WHERE idx = s - 60) AS train_start, (SELECT trade_date FROM a WHERE idx = s - 40) AS warmup_start,
(SELECT trade_date FROM a WHERE idx = s) AS test_start, (SELECT trade_date FROM a WHERE idx = s + 19) AS test_end FROM w""",
}
