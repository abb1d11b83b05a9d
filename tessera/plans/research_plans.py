"""Regime, portfolio and learning queries."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.factors import REGISTRY
from tessera.operators import boosting as B
from tessera.operators import desk as D
from tessera.operators import evaluation as E
from tessera.operators import ml as M
from tessera.operators import paper
from tessera.operators import portfolio as P
from tessera.operators import regime as G
from tessera.operators.grid import dense_grid
from tessera.plans.evaluation_plans import _mad, _round
from tessera.plans.factor_plans import FACTOR_SQL, SQL_BASE, SQL_GRID, SQL_WINDOWS
from tessera.plans.strategy_plans import ALL, _ranks, _weights, _weights_sql
from tessera.session import Folder
from tessera.sources.manifest import GuardedTables
from tessera.sources.tables import SQL_BARS, SQL_INDEX, SQL_STOCKS, bars, index_bars, load, stocks

AS_OF = "1999-06-28"
NAMES = ["volatility_20d", "momentum_20d", "amount_stability_20d"]


def regime_metrics(spark, sf_dir):
    """Regime of every index date."""
    out = G.classify(G.index_metrics(index_bars(spark, sf_dir)))
    return _round(out.select("trade_date", "regime", "confidence", "trend_score", "breadth_score", "volatility_score", "drawdown"), 4)


def regime_reasons(spark, sf_dir):
    """What is said for the regime of every index date."""
    out = G.reasons(G.classify(G.index_metrics(index_bars(spark, sf_dir))))
    return out.select("trade_date", "regime", F.array_join("reasons", " | ").alias("reasons"))


def advice_critique(spark, sf_dir):
    """Findings about every advice (an order): its evidence, its news, its weights (lines) and its validation."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    advice = load(spark, sf_dir, "orders").select(
        k.alias("advice_id"), day.alias("as_of_date"), F.when(k % 12 == 0, "expired").otherwise("reviewed").alias("status"), F.when(k % 3 != 0, F.expr("cast(o_orderdate as date) + cast(o_orderkey % 9 as int) - 7")).alias("market_end"),
        F.expr("cast(o_orderdate as date) - cast(o_orderkey % 5 as int) + 1").alias("factor_end"), (k % 4 - 2).alias("severe_count"), (k % 5 != 0).alias("has_validation"), (k % 7 != 0).alias("validation_matches"))
    lines = load(spark, sf_dir, "lineitem")
    news = lines.where(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("advice_id"), F.col("l_shipdate").cast("date").alias("known_at"))
    weights = lines.select(F.col("l_orderkey").alias("advice_id"), (F.col("l_quantity") / 150).alias("weight"))
    out = D.critique(advice, news, weights)
    shown = F.transform("findings", lambda f: F.concat_ws(":", f["severity"], f["code"], f["citation"]))
    return out.select("advice_id", F.array_join(shown, "; ").alias("findings"), "approved_for_human_review")


def weights_buffered(spark, sf_dir):
    """Choices by score that keep what was held on the date before, up to a later rank."""
    s = _scores(spark, sf_dir).select(F.col("trade_date").alias("decision_date"), "symbol", "score")
    w = Window.partitionBy("decision_date").orderBy(F.desc("score"), "symbol")
    ranks = s.withColumn("rank", F.row_number().over(w))
    dates = ranks.select("decision_date").distinct()
    after = dates.withColumn("next", F.lead("decision_date").over(Window.orderBy("decision_date")))
    held = ranks.where("rank <= 12").join(F.broadcast(after), "decision_date").select(F.col("next").alias("decision_date"), "symbol").where("decision_date is not null")
    return _round(D.buffered(ranks, held, 10, 2.5, 1.0, 0.09, 0.8))


def weights_normalised(spark, sf_dir):
    """Weights of every run over all symbols asked for or held."""
    k = F.col("l_orderkey")
    line = load(spark, sf_dir, "lineitem").select((k % 50).alias("run_id"), F.col("l_suppkey").cast("string").alias("symbol"), "l_linenumber", k.alias("k"))
    line = line.groupBy("run_id", "symbol").agg(F.max("k").alias("k"))
    k = F.col("k")
    raw = line.where(k % 3 != 0).select("run_id", "symbol", F.when(k % 41 == 0, F.lit(None)).otherwise(k % 10 / 100.0).alias("weight"))
    return D.normalised_weights(raw, line.where(k % 2 == 0), line.where(k % 5 == 0))


def market_breadth(spark, sf_dir):
    """Breadth of every date."""
    return _round(G.market_breadth(bars(spark, sf_dir)))


def _fills(spark, sf_dir):
    line = load(spark, sf_dir, "lineitem")
    sign = F.when(F.col("l_returnflag") == "R", -1).otherwise(1)
    return line.select(F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("symbol"), (F.col("l_quantity") * sign).cast("long").alias("quantity"))


def _closes(spark, sf_dir):
    b = bars(spark, sf_dir).where(F.col("trade_date") <= F.lit(AS_OF).cast("date"))
    return b.groupBy("symbol").agg(F.max_by("close", "trade_date").alias("price"))


def positions(spark, sf_dir):
    """Aggregated positions."""
    return P.aggregate_positions(_fills(spark, sf_dir))


def portfolio_state(spark, sf_dir):
    """Positions valued at their last close."""
    return _round(P.valued(P.aggregate_positions(_fills(spark, sf_dir)), _closes(spark, sf_dir)), 4)


def portfolio_diagnostics(spark, sf_dir):
    """Weights, concentration, drawdown and warnings."""
    held, cash = P.aggregate_positions(_fills(spark, sf_dir)), 500_000.0
    past = bars(spark, sf_dir).where(F.col("trade_date") <= F.lit(AS_OF).cast("date"))
    return _round(P.diagnostics(P.valued(held, _closes(spark, sf_dir)), cash, P.valuations(held, past, cash)))


def _targets(spark, sf_dir):
    s = load(spark, sf_dir, "supplier")
    return s.select(F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("symbol"), (F.col("s_suppkey") % 7 / 60.0).alias("weight"))


def trade_plan(spark, sf_dir):
    """Orders to reach targets."""
    return _round(P.trade_plan(_targets(spark, sf_dir), P.aggregate_positions(_fills(spark, sf_dir)), _closes(spark, sf_dir), 5e8))


def portfolio_review(spark, sf_dir):
    """Current, advised and planned weights side by side."""
    t = _targets(spark, sf_dir)
    k = F.col("symbol").cast("int")
    return _round(P.review(t.where(k % 2 == 0), t.where(k % 3 != 0).withColumn("weight", F.col("weight") * 1.5), t.where(k > 20)))


def weight_validation(spark, sf_dir):
    """Runs whose weights are invalid."""
    o = load(spark, sf_dir, "orders")
    w = o.select((F.col("o_orderkey") % 40).cast("string").alias("run_id"), (F.when(F.col("o_orderkey") % 97 == 0, -1.0).when(F.col("o_orderkey") % 89 == 0, F.lit(None)).otherwise(F.col("o_orderkey") % 10 / 40.0)).alias("weight"))
    return P.weight_problems(w)


def _scores(spark, sf_dir):
    b = bars(spark, sf_dir)
    return b.select("trade_date", "symbol", F.round(F.col("close") / F.col("open") - 1, 8).alias("score"))


def prediction_weights(spark, sf_dir):
    """Scores to weights."""
    return _round(P.predictions_to_weights(_scores(spark, sf_dir), 12, 0.1, 0.9))


def advisory_outcomes(spark, sf_dir):
    """What became of advised weights after 1, 5 and 20 dates."""
    return _round(P.outcomes(_weights(spark, sf_dir), dense_grid(bars(spark, sf_dir)), index_bars(spark, sf_dir)))


def advisory_expiry(spark, sf_dir):
    """Advice whose day of execution newer bars have passed."""
    w = _weights(spark, sf_dir)
    advice = w.select(F.col("decision_date").cast("string").alias("advice_id"), F.col("decision_date").alias("as_of"), "symbol")
    return P.expired(advice, bars(spark, sf_dir), bars(spark, sf_dir).select("trade_date").distinct())


def _runs(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(F.col("c_name").alias("run_id"), F.round(F.col("c_acctbal") / 20000, 6).alias("annual_return"), ((k % 37 - 12) / 10.0).alias("sharpe"), (-(k % 41) / 100.0).alias("max_drawdown"), ((k % 29 - 9) / 10.0).alias("stressed_sharpe"), (k % 7).alias("n_windows"))


def run_ranking(spark, sf_dir):
    """The best runs."""
    return _round(P.best_candidates(_runs(spark, sf_dir)).select("run_id", "score"))


def run_eligibility(spark, sf_dir):
    """Status and flags of runs."""
    c = load(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    runs = c.select(F.col("c_name").alias("run_id"), (k % 5 != 0).alias("pit_source"), (k % 11).alias("n_dates"), (k % 7 != 0).alias("benchmark_complete"), (k % 8).alias("n_windows"), (k % 37 * 9).alias("oos_days"))
    return P.eligibility(runs).select("run_id", "status", "flags")


def _validated(spark, sf_dir):
    """Validations (orders), runs and provenance (customers); some of each disagree."""
    c, k, v = load(spark, sf_dir, "customer"), F.col("c_custkey"), F.col("o_orderkey")
    runs = c.select(k.alias("run_id"), F.col("c_mktsegment").alias("strategy_name"))
    provenance = c.where(k % 5 != 0).select(k.alias("run_id"), F.concat(F.lit("p"), k.cast("string")).alias("fingerprint"))
    print_of = F.concat(F.lit("p"), F.col("o_custkey").cast("string"))
    validations = load(spark, sf_dir, "orders").join(c.select(k.alias("o_custkey"), "c_mktsegment"), "o_custkey").select(
        v.alias("validation_id"), F.col("o_custkey").alias("run_id"), F.when(v % 7 == 0, "failed").otherwise("completed").alias("status"), F.when(v % 3 == 0, "watch").otherwise("eligible").alias("eligibility_status"),
        F.when(v % 11 == 0, "stale").otherwise(print_of).alias("source_fingerprint"), F.when(v % 13 == 0, "other").otherwise(F.col("c_mktsegment")).alias("spec_strategy"),
        F.when(v % 17 == 0, F.lit(-1)).otherwise(F.col("o_custkey")).alias("spec_run_id"), F.when(v % 19 == 0, F.lit(None)).otherwise(print_of).alias("spec_fingerprint"),
        F.when(v % 23 != 0, F.col("o_orderdate").cast("date")).alias("as_of_date"), ((v % 601 - 99) / 100.0).alias("annual_return"), ((v % 41 - 20) / 2.0).alias("sharpe"), (-(v % 29) / 100.0).alias("max_drawdown"),
        ((v % 43 - 21) / 2.0).alias("stressed_sharpe"), F.concat(F.lit("v"), v.cast("string")).alias("fingerprint"))
    return validations, runs, provenance


def strategy_candidates(spark, sf_dir):
    """The best validations that run and provenance confirm."""
    return P.strategy_candidates(*_validated(spark, sf_dir))


def snapshot_matches(spark, sf_dir):
    """Whether each advice's validation still stands."""
    validations, runs, provenance = _validated(spark, sf_dir)
    v = F.col("validation_id")
    advice = validations.select(
        v.alias("advice_id"), F.when(v % 31 == 0, "other").otherwise(F.col("spec_strategy")).alias("strategy_name"), F.when(v % 37 == 0, F.date_add("as_of_date", 1)).otherwise(F.col("as_of_date")).alias("as_of_date"),
        F.when(v % 5 == 0, -v).otherwise(v).alias("validation_id"), F.col("run_id").alias("snapshot_run_id"), F.when(v % 29 == 0, "old").otherwise(F.col("fingerprint")).alias("snapshot_fingerprint"), F.col("as_of_date").alias("snapshot_as_of"))
    return P.snapshot_matches(advice, validations, runs, provenance)


def promotion_eligibility(spark, sf_dir):
    """Reasons against promoting each advice: one a validation, some unreviewed, without evidence, or with windows that are few, late, or overlap."""
    validations, runs, provenance = _validated(spark, sf_dir)
    v, day = F.col("validation_id"), F.coalesce("as_of_date", F.lit("1999-01-01").cast("date"))
    advice = validations.select(
        v.alias("advice_id"), F.when(v % 31 == 0, "other").otherwise(F.col("spec_strategy")).alias("strategy_name"), day.alias("as_of_date"), F.when(v % 4 == 0, "draft").otherwise("reviewed").alias("status"),
        F.when(v % 9 != 0, day).alias("reviewed_at"), (v % 6 != 0).alias("has_evidence"), F.when(v % 10 == 0, F.lit(0)).when(v % 14 == 0, -v + 2_000_000_000).otherwise(v).alias("validation_id"),
        F.col("run_id").alias("ev_run_id"), F.when(v % 29 == 0, "old").otherwise(F.col("fingerprint")).alias("ev_fingerprint"), day.alias("ev_as_of"))
    number = F.explode(F.sequence(F.lit(1), (v % 5 + 1).cast("int"))).alias("k")
    windows = validations.select("validation_id", day.alias("d"), number).where((F.col("validation_id") % 15 != 0)).select(
        "validation_id", F.expr("d - cast(30 * k - 30 as int) - 29").alias("oos_start"), F.expr("d - cast(30 * k - 30 as int) + case when validation_id % 31 = 5 then 1 else 0 end - case when validation_id % 37 = 3 then 1 else 0 end").alias("oos_end"),
        (F.col("validation_id") % 41 != 7).alias("has_result"))
    expired = validations.select(v.alias("advice_id"), (v % 8 == 1).alias("expired"))
    return paper.promotion_eligibility(advice, expired, validations, runs, provenance, windows)


def _wanted(spark, sf_dir, day, step):
    """Weights of securities that have a bar on a day."""
    k = F.col("symbol").cast("int")
    return bars(spark, sf_dir).where(F.col("trade_date") == day).where(k % step == 0).select("symbol", (F.lit(0.9) * (k % 7 + 1) / 8 / 40).alias("weight"))


def portfolio_snapshot(spark, sf_dir):
    """Positions and value after a snapshot, a promotion at a later day, and the same promotion again.

    Every second security of the day is bought, however many there are, so the account is one on margin.
    """
    p, b, s = paper.PaperPortfolio(spark, Folder(spark, "paper").path("p")), bars(spark, sf_dir), stocks(spark, sf_dir)
    p.save("1997-01-27", 1000.0, _wanted(spark, sf_dir, "1997-01-27", 3).select("symbol", F.lit(100).alias("quantity")), s, b)
    for _ in range(2):
        p.promote(AS_OF, 50_000_000.0, _wanted(spark, sf_dir, AS_OF, 2), s, b, capital=math.inf)
    # binary ties as SQL's round takes them
    r = lambda c, n: F.round(F.col(c) * 10.0**n) / 10.0**n
    held = p.positions().select(F.col("price_date").alias("as_of"), "symbol", "quantity", r("reference_price", 4).alias("price"))
    return p.valuations().join(held, "as_of", "left").select("as_of", r("position_value", 1).alias("position_value"), r("equity", 1).alias("equity"), "symbol", "quantity", "price")


def validation_cemetery(spark, sf_dir):
    """What became of all validations that were stored in two overlapping deliveries: rejected ones lie in the cemetery, each once."""
    v, runs, _ = _validated(spark, sf_dir)
    k = F.col("validation_id")
    rows = v.select("validation_id", "run_id", F.col("spec_strategy").alias("strategy_name"), "eligibility_status", F.array(F.when(k % 2 == 0, "too few windows"), F.when(k % 5 == 0, "stale")).alias("flags"), "fingerprint")
    tables = GuardedTables(spark, Folder(spark, "validations").path("t"))
    paper.save_validations(tables, rows.where(k % 3 != 1))
    paper.save_validations(tables, rows.where(k % 3 != 2))
    return tables.table("cemetery")


def window_metric_means(spark, sf_dir):
    """Mean metrics over the windows (orders) of each validation (customer)."""
    v = F.col("o_orderkey")
    cols = [F.when(v % (7 + i) != 0, (v % (31 + 2 * i) - 15).cast("double")).alias(m) for i, m in enumerate(P.WINDOW_METRICS)]
    return _round(P.window_metric_means(load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("validation_id"), *cols)))


def variant_winner(spark, sf_dir):
    """Who wins of two runs."""
    return _round(P.variant_winner(_runs(spark, sf_dir).withColumn("excess_return", F.col("annual_return") - 0.05), "Customer#000000003", "Customer#000000008"))


def traded_by_one(spark, sf_dir):
    """Customers that only one of two order states has; the states stand for runs."""
    o = load(spark, sf_dir, "orders")
    return P.traded_by_one(o.select(F.col("o_orderstatus").alias("run_id"), F.lpad(F.col("o_custkey").cast("string"), 6, "0").alias("symbol")), "F", "P")


def variant_comparison(spark, sf_dir):
    """Two runs, metric by metric."""
    r = _runs(spark, sf_dir)
    return _round(P.compare_variants(r, "Customer#000000003", "Customer#000000008", ("annual_return", "sharpe", "max_drawdown")))


def ml_dataset(spark, sf_dir):
    """Features and labels."""
    return _round(M.dataset(bars(spark, sf_dir), NAMES))


def ml_windows(spark, sf_dir):
    """Calendar windows with embargo."""
    return _round(M.calendar_windows(bars(spark, sf_dir)))


def ml_feature_matrix(spark, sf_dir):
    """All factors of the registry, standardised by date, with labels; factors are rounded before."""
    m = M.factor_matrix(bars(spark, sf_dir), digits=8)
    return m.select("trade_date", "symbol", *((F.round(c, 4) + 0.0).alias(c) for c in ("fwd_5d", "fwd_10d", *REGISTRY)))


def _walk(spark, sf_dir):
    b = bars(spark, sf_dir)
    return B.walk_forward(M.dataset(b, NAMES), M.calendar_windows(b), NAMES, "fwd_5d", B.Settings(rounds=4, depth=3))


def ml_walk_forward(spark, sf_dir):
    """Boosted trees for each calendar window, its test span scored, rank IC by date; a model has no SQL."""
    return M.rank_ic_by_date(_walk(spark, sf_dir).scores.withColumnRenamed("label", "fwd_5d"), "fwd_5d")


def ml_importance(spark, sf_dir):
    """Share of the gain that each feature brought, over all windows."""
    return spark.createDataFrame(_walk(spark, sf_dir).importance(), "feature string, share double")


def ml_rank_ic(spark, sf_dir):
    """Rank IC of a score."""
    grid = M.forward_returns(dense_grid(bars(spark, sf_dir)), (5,)).select("trade_date", "symbol", F.round("fwd_5d", 8).alias("fwd_5d"))
    return _round(M.rank_ic_by_date(_scores(spark, sf_dir).join(grid, ["trade_date", "symbol"]), "fwd_5d"))


def ml_score_rank(spark, sf_dir):
    """Same-date scores without gaps, blocked and illiquid names."""
    b = bars(spark, sf_dir)
    k = F.col("symbol").cast("int")
    gaps = b.where((k + F.month("trade_date")) % 11 == 0).select("trade_date", "symbol")
    blocked = b.where((k + F.year("trade_date")) % 13 == 0).select(F.col("trade_date").alias("decision_date"), "symbol")
    liquid = b.where("amount >= 60000").select(F.col("trade_date").alias("decision_date"), "symbol")
    return _round(M.ml_targets(_scores(spark, sf_dir), gaps, blocked, liquid, 0.0), 8)


QUERIES = {f.__name__: f for f in (
    regime_metrics, regime_reasons, advice_critique, weights_buffered, weights_normalised, market_breadth, positions, portfolio_state, portfolio_diagnostics, trade_plan, portfolio_review, weight_validation, prediction_weights, advisory_outcomes,
    advisory_expiry, run_ranking, run_eligibility, variant_comparison, strategy_candidates, snapshot_matches, promotion_eligibility, portfolio_snapshot, validation_cemetery, window_metric_means, variant_winner, traded_by_one, ml_dataset, ml_feature_matrix, ml_windows, ml_walk_forward, ml_importance, ml_rank_ic, ml_score_rank)}

_W = "(ORDER BY trade_date ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
_w = lambda n: _W.format(n - 1)
_POS = """p AS (SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS symbol, CAST(sum(CAST(l_quantity * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS BIGINT)) AS BIGINT) AS quantity
FROM lineitem GROUP BY 1 HAVING sum(CAST(l_quantity * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS BIGINT)) <> 0)"""
_CLOSE = f"c AS (SELECT symbol, arg_max(close, trade_date) AS price FROM bars WHERE trade_date <= DATE '{AS_OF}' GROUP BY 1)"
_VALUED = f"{SQL_BARS}, {_POS}, {_CLOSE}, v AS (SELECT p.symbol, quantity, price, round(quantity * price, 2) AS market_value FROM p LEFT JOIN c USING (symbol))"
_T = "t AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS symbol, s_suppkey % 7 / 60.0::DOUBLE AS weight FROM supplier)"
_SCORE = "s AS (SELECT trade_date, symbol, round(close / open - 1, 8) AS score FROM bars)"
_RUNS = """r AS (SELECT c_name AS run_id, round(c_acctbal / 20000, 6) AS annual_return, (c_custkey % 37 - 12) / 10.0::DOUBLE AS sharpe, -(c_custkey % 41) / 100.0::DOUBLE AS max_drawdown,
(c_custkey % 29 - 9) / 10.0::DOUBLE AS stressed_sharpe, c_custkey % 7 AS n_windows FROM customer)"""
_VALID = """r AS (SELECT c_custkey AS run_id, c_mktsegment AS strategy_name, CASE WHEN c_custkey % 5 <> 0 THEN 'p' || c_custkey END AS p FROM customer),
v AS (SELECT o_orderkey AS k, o_custkey AS run_id, strategy_name, p, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderkey % 13 = 0 THEN 'other' ELSE strategy_name END AS spec_strategy FROM orders JOIN r ON run_id = o_custkey),
ok AS (SELECT * FROM v WHERE p IS NOT NULL AND k % 7 <> 0 AND k % 3 <> 0 AND k % 11 <> 0 AND k % 13 <> 0 AND k % 17 <> 0 AND k % 19 <> 0 AND k % 23 <> 0)"""
ORACLE = {
    "strategy_candidates": f"""WITH {_VALID}, m AS (SELECT *, (k % 601 - 99) / 100.0::DOUBLE AS a, (k % 41 - 20) / 2.0::DOUBLE AS s, (k % 29) / 100.0::DOUBLE AS dd, (k % 43 - 21) / 2.0::DOUBLE AS t FROM ok),
q AS (SELECT *, round(a * 100 + s * 10 - dd * 40 + t * 5, 6) AS score FROM m WHERE a BETWEEN -1 AND 5 AND s BETWEEN -10 AND 10 AND t BETWEEN -10 AND 10)
SELECT CAST(row_number() OVER (ORDER BY score DESC, d DESC, k DESC) AS INT) AS rank, k AS validation_id, run_id, strategy_name, d AS as_of_date, score FROM q ORDER BY score DESC, d DESC, k DESC LIMIT 100""",
    "snapshot_matches": f"WITH {_VALID} SELECT v.k AS advice_id, ok.k IS NOT NULL AND v.k % 31 <> 0 AND v.k % 37 <> 0 AND v.k % 5 <> 0 AND v.k % 29 <> 0 AS matches FROM v LEFT JOIN ok ON ok.k = v.k",
    "window_metric_means": "SELECT o_custkey AS validation_id, " + ", ".join(
        f"round(avg(CASE WHEN o_orderkey % {7 + i} <> 0 THEN o_orderkey % {31 + 2 * i} - 15 ELSE 0 END), 6) + 0.0 AS {m}" for i, m in enumerate(P.WINDOW_METRICS)) + " FROM orders GROUP BY 1",
    "variant_winner": f"""WITH {_RUNS}, d AS (SELECT o.max_drawdown - b.max_drawdown AS dd, o.annual_return - b.annual_return AS e, o.sharpe - b.sharpe AS s FROM r o, r b WHERE o.run_id = 'Customer#000000008' AND b.run_id = 'Customer#000000003')
SELECT round(dd, 6) + 0.0 AS max_drawdown_delta, round(e, 6) + 0.0 AS excess_return_delta, round(s, 6) + 0.0 AS sharpe_delta,
CASE WHEN dd > 0 THEN 'other' WHEN dd < 0 THEN 'base' WHEN e > 0 THEN 'other' WHEN e < 0 THEN 'base' WHEN s > 0 THEN 'other' WHEN s < 0 THEN 'base' ELSE 'tie' END AS winner FROM d""",
    "traded_by_one": """WITH t AS (SELECT DISTINCT o_orderstatus AS run_id, lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS symbol FROM orders WHERE o_orderstatus IN ('F', 'P')),
o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY symbol) AS k FROM t x WHERE NOT EXISTS (SELECT 1 FROM t y WHERE y.symbol = x.symbol AND y.run_id <> x.run_id)) SELECT run_id, symbol FROM o WHERE k <= 50""",
    "regime_metrics": f"""WITH {SQL_INDEX}, a AS (SELECT trade_date, close, close / lag(close) OVER (ORDER BY trade_date) - 1 AS r, row_number() OVER (ORDER BY trade_date) AS rn,
  avg(close) OVER {_w(20)} AS a20, avg(close) OVER {_w(60)} AS a60, avg(close) OVER {_w(120)} AS a120, max(close) OVER {_w(120)} AS hi FROM index_bars),
m AS (SELECT *, CASE WHEN rn >= 20 THEN a20 END AS m20, CASE WHEN rn >= 60 THEN a60 END AS m60, CASE WHEN rn >= 120 THEN a120 END AS m120 FROM a),
s AS (SELECT *, CASE WHEN rn >= 40 THEN lag(m20, 20) OVER (ORDER BY trade_date) WHEN rn >= 21 THEN (SELECT m20 FROM m WHERE rn = 20) END AS base,
  (SELECT avg(CASE WHEN x.m20 > x.m60 AND x.m60 > x.m120 THEN 1.0::DOUBLE ELSE 0 END) FROM m x WHERE x.rn BETWEEN m.rn - 19 AND m.rn) AS al,
  (SELECT avg(CASE WHEN x.r > 0 THEN 1.0::DOUBLE ELSE 0 END) FROM m x WHERE x.rn BETWEEN m.rn - 18 AND m.rn) AS up, stddev_samp(r) OVER {_w(20)} AS sd FROM m),
g AS (SELECT trade_date, rn, (coalesce(1 / (1 + exp(-(close / m20 - 1) / 0.05)), 0.5) + coalesce(1 / (1 + exp(-(m20 / m60 - 1) / 0.03)), 0.5) + coalesce(1 / (1 + exp(-(m60 / m120 - 1) / 0.03)), 0.5)
    + coalesce(1 / (1 + exp(-(m20 / base - 1) / 0.03)), 0.5)) / 4 AS t, 0.6 * al + 0.4 * up AS b, CASE WHEN sd > 0 THEN 1 / (1 + exp(-(sd * sqrt(252) - 0.35) / 0.12)) ELSE 0 END AS v,
  CASE WHEN rn >= 120 THEN greatest(0, 1 - close / hi) ELSE 0 END AS d FROM s),
c AS (SELECT *, CASE WHEN v >= 0.7 AND d >= 0.15 AND t <= 0.4 THEN ['PANIC', greatest(0.6, least(0.95, 0.6 + 0.4 * ((v - 0.7) / 0.3 + (d - 0.15) / 0.5) / 2))::VARCHAR]
  WHEN d >= 0.35 THEN ['PANIC', greatest(0.6, least(0.95, 0.6 + d))::VARCHAR] WHEN t >= 0.65 AND v >= 0.55 AND d <= 0.1 THEN ['EUPHORIA', greatest(0.55, least(0.9, 0.5 + 0.4 * t + 0.3 * v))::VARCHAR]
  WHEN t >= 0.55 AND b >= 0.4 AND v <= 0.6 AND d <= 0.15 THEN ['BULL', greatest(0.5, least(0.9, 0.4 + 0.4 * t + 0.2 * b))::VARCHAR] WHEN t >= 0.5 AND b >= 0.6 THEN ['BULL', greatest(0.45, least(0.85, 0.4 + 0.4 * b + 0.2 * t))::VARCHAR]
  WHEN t <= 0.35 AND b <= 0.3 THEN ['BEAR', greatest(0.5, least(0.9, 0.5 + 0.3 * (0.5 - t) + 0.2 * (0.5 - b) + 0.2 * d))::VARCHAR] WHEN d >= 0.2 AND t <= 0.4 THEN ['BEAR', greatest(0.5, least(0.85, 0.5 + 0.3 * d + 0.2 * (0.5 - t)))::VARCHAR]
  WHEN t <= 0.25 THEN ['BEAR', greatest(0.55, least(0.9, 0.6 + 0.4 * (0.5 - t)))::VARCHAR] ELSE ['SIDEWAYS', greatest(0.3, least(0.75, 1 - (abs(t - 0.5) * 2 + abs(b - 0.5) + abs(v - 0.4)) / 3))::VARCHAR] END AS k FROM g)
SELECT trade_date, CASE WHEN rn >= 20 THEN k[1] ELSE 'SIDEWAYS' END AS regime, CASE WHEN rn >= 20 THEN round(CAST(k[2] AS DOUBLE) * least(1, rn / 120.0::DOUBLE), 4) + 0.0 ELSE 0.0 END AS confidence,
  CASE WHEN rn >= 20 THEN round(t, 4) + 0.0 ELSE 0.5 END AS trend_score, CASE WHEN rn >= 20 THEN round(b, 4) + 0.0 ELSE 0.0 END AS breadth_score, CASE WHEN rn >= 20 THEN round(v, 4) + 0.0 ELSE 0.0 END AS volatility_score,
  CASE WHEN rn >= 20 THEN round(d, 4) + 0.0 ELSE 0.0 END AS drawdown FROM c""",
    "regime_reasons": f"""WITH {SQL_INDEX}, a AS (SELECT trade_date, close, close / lag(close) OVER (ORDER BY trade_date) - 1 AS r, row_number() OVER (ORDER BY trade_date) AS rn,
  avg(close) OVER {_w(20)} AS a20, avg(close) OVER {_w(60)} AS a60, avg(close) OVER {_w(120)} AS a120, max(close) OVER {_w(120)} AS hi, max(close) OVER {_w(20)} AS h20 FROM index_bars),
m AS (SELECT *, CASE WHEN rn >= 20 THEN a20 END AS m20, CASE WHEN rn >= 60 THEN a60 END AS m60, CASE WHEN rn >= 120 THEN a120 END AS m120 FROM a),
s AS (SELECT *, CASE WHEN rn >= 40 THEN lag(m20, 20) OVER (ORDER BY trade_date) WHEN rn >= 21 THEN (SELECT m20 FROM m WHERE rn = 20) END AS base,
  (SELECT avg(CASE WHEN x.m20 > x.m60 AND x.m60 > x.m120 THEN 1.0::DOUBLE ELSE 0 END) FROM m x WHERE x.rn BETWEEN m.rn - 19 AND m.rn) AS al,
  (SELECT avg(CASE WHEN x.r > 0 THEN 1.0::DOUBLE ELSE 0 END) FROM m x WHERE x.rn BETWEEN m.rn - 18 AND m.rn) AS up, stddev_samp(r) OVER {_w(20)} AS sd FROM m),
g AS (SELECT trade_date, rn, (coalesce(1 / (1 + exp(-(close / m20 - 1) / 0.05)), 0.5) + coalesce(1 / (1 + exp(-(m20 / m60 - 1) / 0.03)), 0.5) + coalesce(1 / (1 + exp(-(m60 / m120 - 1) / 0.03)), 0.5)
    + coalesce(1 / (1 + exp(-(m20 / base - 1) / 0.03)), 0.5)) / 4 AS t, 0.6 * al + 0.4 * up AS b, CASE WHEN sd > 0 THEN 1 / (1 + exp(-(sd * sqrt(252) - 0.35) / 0.12)) ELSE 0 END AS v,
  CASE WHEN rn >= 120 THEN greatest(0, 1 - close / hi) ELSE 0 END AS d, close, m20, m60, h20 FROM s),
c AS (SELECT *, CASE WHEN v >= 0.7 AND d >= 0.15 AND t <= 0.4 THEN ['PANIC', greatest(0.6, least(0.95, 0.6 + 0.4 * ((v - 0.7) / 0.3 + (d - 0.15) / 0.5) / 2))::VARCHAR]
  WHEN d >= 0.35 THEN ['PANIC', greatest(0.6, least(0.95, 0.6 + d))::VARCHAR] WHEN t >= 0.65 AND v >= 0.55 AND d <= 0.1 THEN ['EUPHORIA', greatest(0.55, least(0.9, 0.5 + 0.4 * t + 0.3 * v))::VARCHAR]
  WHEN t >= 0.55 AND b >= 0.4 AND v <= 0.6 AND d <= 0.15 THEN ['BULL', greatest(0.5, least(0.9, 0.4 + 0.4 * t + 0.2 * b))::VARCHAR] WHEN t >= 0.5 AND b >= 0.6 THEN ['BULL', greatest(0.45, least(0.85, 0.4 + 0.4 * b + 0.2 * t))::VARCHAR]
  WHEN t <= 0.35 AND b <= 0.3 THEN ['BEAR', greatest(0.5, least(0.9, 0.5 + 0.3 * (0.5 - t) + 0.2 * (0.5 - b) + 0.2 * d))::VARCHAR] WHEN d >= 0.2 AND t <= 0.4 THEN ['BEAR', greatest(0.5, least(0.85, 0.5 + 0.3 * d + 0.2 * (0.5 - t)))::VARCHAR]
  WHEN t <= 0.25 THEN ['BEAR', greatest(0.55, least(0.9, 0.6 + 0.4 * (0.5 - t)))::VARCHAR] ELSE ['SIDEWAYS', greatest(0.3, least(0.75, 1 - (abs(t - 0.5) * 2 + abs(b - 0.5) + abs(v - 0.4)) / 3))::VARCHAR] END AS k FROM g),
z AS (SELECT *, CASE WHEN v >= 0.7 AND d >= 0.15 AND t <= 0.4 THEN 1 WHEN d >= 0.35 THEN 2 WHEN t >= 0.65 AND v >= 0.55 AND d <= 0.1 THEN 3 WHEN t >= 0.55 AND b >= 0.4 AND v <= 0.6 AND d <= 0.15 THEN 4 WHEN t >= 0.5 AND b >= 0.6 THEN 5
  WHEN t <= 0.35 AND b <= 0.3 THEN 6 WHEN d >= 0.2 AND t <= 0.4 THEN 7 WHEN t <= 0.25 THEN 8 ELSE 9 END AS rule FROM c)
SELECT trade_date, CASE WHEN rn >= 20 THEN k[1] ELSE 'SIDEWAYS' END AS regime, CASE WHEN rn >= 20 THEN concat_ws(' | ', CASE WHEN m20 > m60 THEN printf('MA20(%.2f) > MA60(%.2f) — golden cross zone', m20, m60) WHEN m20 <= m60 THEN printf('MA20(%.2f) < MA60(%.2f) — death cross zone', m20, m60) END,
  printf('距20日高点 %+.1f%%', (close - h20) / h20 * 100), CASE WHEN d > 0.05 THEN printf('%.1f%% 从120日高点回撤', d * 100) END, CASE WHEN v > 0.6 THEN printf('高波动率 (%.2f)', v) END, ([{', '.join(f"'{x}'" for x in G.RULE_REASONS)}])[rule]) ELSE 'Only ' || rn || ' bars (< 20); insufficient for regime classification.' END AS reasons FROM z""",
    "advice_critique": """WITH a AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders), n AS (SELECT k, min(CAST(l_shipdate AS DATE)) AS late FROM lineitem JOIN a ON k = l_orderkey WHERE l_returnflag = 'R' AND CAST(l_shipdate AS DATE) > d GROUP BY 1),
w AS (SELECT l_orderkey AS k, max(l_quantity / 150) AS most FROM lineitem GROUP BY 1), j AS (SELECT a.*, late, most, CASE WHEN k % 3 <> 0 THEN d + CAST(k % 9 AS INT) - 7 END AS m, d - CAST(k % 5 AS INT) + 1 AS f FROM a LEFT JOIN n USING (k) LEFT JOIN w USING (k)),
l AS (SELECT k, list_filter([CASE WHEN m > d THEN 'blocker:future_market_evidence:' || m END, CASE WHEN f > d THEN 'blocker:future_factor_evidence:' || f END, CASE WHEN late IS NOT NULL THEN 'blocker:future_news_evidence:' || late END,
  CASE WHEN k % 4 - 2 > 0 THEN 'warning:severe_company_news:persisted news evidence' END, CASE WHEN most > 0.3 THEN 'warning:concentrated_target:risk-gated target weights' END, CASE WHEN k % 5 = 0 THEN 'warning:missing_oos_validation:advisory evidence snapshot' END,
  CASE WHEN k % 5 <> 0 AND k % 7 = 0 THEN 'blocker:invalid_oos_validation:advisory evidence snapshot' END, CASE WHEN k % 12 = 0 THEN 'blocker:expired_draft:' || d END], lambda x: x IS NOT NULL) AS l FROM j)
SELECT k AS advice_id, array_to_string(l, '; ') AS findings, len(list_filter(l, lambda x: starts_with(x, 'blocker'))) = 0 AS approved_for_human_review FROM l""",
    "weights_buffered": f"""WITH {SQL_BARS}, {_SCORE}, r AS (SELECT trade_date AS d, symbol, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, symbol) AS rank FROM s),
nx AS (SELECT d, lead(d) OVER (ORDER BY d) AS nd FROM (SELECT DISTINCT d FROM r)), h AS (SELECT nd AS d, symbol FROM r JOIN nx USING (d) WHERE rank <= 12 AND nd IS NOT NULL),
o AS (SELECT r.*, h.symbol IS NOT NULL AND rank <= 25 AS own FROM r LEFT JOIN h ON h.d = r.d AND h.symbol = r.symbol), p AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY own DESC, rank) AS k FROM o WHERE own OR rank <= 10)
SELECT d AS decision_date, symbol, round(least(0.09, 0.8 / count(*) OVER (PARTITION BY d)), 6) + 0.0 AS weight FROM p WHERE k <= 10""",
    "weights_normalised": """WITH l AS (SELECT l_orderkey % 50 AS run_id, CAST(l_suppkey AS VARCHAR) AS symbol, max(l_orderkey) AS k FROM lineitem GROUP BY 1, 2)
SELECT run_id, symbol, CASE WHEN k % 3 = 0 THEN 0.0 WHEN k % 41 <> 0 THEN k % 10 / 100.0 END::DOUBLE AS weight, CASE WHEN k % 3 <> 0 AND k % 41 = 0 THEN 'not_finite' END AS problem FROM l WHERE k % 2 = 0 OR k % 5 = 0""",
    "market_breadth": f"""WITH {SQL_BARS}, a AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date) AS rn, avg(close) OVER (PARTITION BY symbol ORDER BY trade_date ROWS 19 PRECEDING) AS m20,
  avg(close) OVER (PARTITION BY symbol ORDER BY trade_date ROWS 59 PRECEDING) AS m60 FROM bars)
SELECT trade_date, round(avg(((close > m20)::INT + (close > m60)::INT) / 2.0::DOUBLE), 6) + 0.0 AS breadth, count(*) AS n FROM a WHERE rn >= 60 GROUP BY 1""",
    "positions": f"WITH {_POS} SELECT * FROM p",
    "portfolio_state": f"WITH {_VALUED} SELECT symbol, quantity, round(price, 4) + 0.0 AS price, round(market_value, 4) + 0.0 AS market_value FROM v",
    "portfolio_diagnostics": f"""WITH {_VALUED}, k AS (SELECT market_value AS mv, row_number() OVER (ORDER BY market_value DESC NULLS LAST) AS k FROM v),
d AS (SELECT sum(mv) + 500000 AS e, sum(mv) AS pv, sum(mv * mv) AS sq, max(mv) FILTER (k = 1) AS l, sum(mv) FILTER (k <= 3) AS t FROM k),
h AS (SELECT trade_date, round(sum(quantity * close) + 500000, 2) AS e FROM bars JOIN p USING (symbol) WHERE trade_date <= DATE '{AS_OF}' GROUP BY 1),
q AS (SELECT trade_date, CASE WHEN greatest(0, max(e) OVER (ORDER BY trade_date)) > 0 THEN e / greatest(0, max(e) OVER (ORDER BY trade_date)) - 1 ELSE 0 END AS dd FROM h),
f AS (SELECT arg_max(dd, trade_date) AS cur, least(0, min(dd)) AS deep FROM q),
w AS (SELECT CASE WHEN e > 0 THEN 500000 / e ELSE 0 END AS cw, CASE WHEN e > 0 THEN pv / e ELSE 0 END AS g, CASE WHEN e > 0 THEN l / e ELSE 0 END AS lw, CASE WHEN e > 0 THEN t / e ELSE 0 END AS tw, CASE WHEN e > 0 THEN sq / (e * e) ELSE 0 END AS hhi, e, cur, deep FROM d, f)
SELECT round(cw, 6) + 0.0 AS cash_weight, round(g, 6) + 0.0 AS gross_exposure, round(lw, 6) + 0.0 AS largest_position_weight, round(tw, 6) + 0.0 AS top_three_weight, round(hhi, 6) + 0.0 AS concentration_hhi,
  round(cur, 6) + 0.0 AS current_drawdown, round(deep, 6) + 0.0 AS max_drawdown, array_to_string(list_filter([CASE WHEN e <= 0 THEN 'No positive portfolio equity is available for risk diagnostics.' END,
  CASE WHEN lw > 0.3 THEN 'Largest holding exceeds 30% of portfolio equity.' END, CASE WHEN tw > 0.65 THEN 'Top three holdings exceed 65% of portfolio equity.' END,
  CASE WHEN cw < 0.05 AND e > 0 THEN 'Cash reserve is below 5% of portfolio equity.' END, CASE WHEN cur <= -0.1 THEN 'Current equity is more than 10% below its recorded peak.' END], lambda x: x IS NOT NULL), ' ') AS warnings FROM w""",
    "trade_plan": f"""WITH {SQL_BARS}, {_POS}, {_CLOSE}, {_T}, g AS (SELECT t.symbol, price, weight * 5e8 - coalesce(quantity, 0) * price AS gap FROM t LEFT JOIN p USING (symbol) JOIN c USING (symbol) WHERE price > 0)
SELECT symbol, CASE WHEN gap > 0 THEN 'buy' ELSE 'sell' END AS side, CAST(floor(abs(gap) / price / 100) * 100 AS BIGINT) AS quantity, round(price, 6) + 0.0 AS price FROM g WHERE floor(abs(gap) / price / 100) > 0""",
    "portfolio_review": f"""WITH {_T}, j AS (SELECT symbol, CASE WHEN CAST(symbol AS INT) % 2 = 0 THEN weight ELSE 0 END AS current, CASE WHEN CAST(symbol AS INT) % 3 <> 0 THEN weight * 1.5 ELSE 0 END AS advised,
  CASE WHEN CAST(symbol AS INT) > 20 THEN weight ELSE 0 END AS planned FROM t WHERE CAST(symbol AS INT) % 2 = 0 OR CAST(symbol AS INT) % 3 <> 0 OR CAST(symbol AS INT) > 20)
SELECT symbol, round(current, 6) + 0.0 AS current, round(advised, 6) + 0.0 AS advised, round(planned, 6) + 0.0 AS planned, round(advised - current, 6) + 0.0 AS delta,
CASE WHEN advised - current > 1e-9 THEN 'increase' WHEN advised - current < -1e-9 THEN 'reduce' ELSE 'keep' END AS action FROM j""",
    "weight_validation": """WITH w AS (SELECT CAST(o_orderkey % 40 AS VARCHAR) AS run_id, CASE WHEN o_orderkey % 97 = 0 THEN -1.0 WHEN o_orderkey % 89 = 0 THEN NULL ELSE o_orderkey % 10 / 40.0 END::DOUBLE AS weight FROM orders),
g AS (SELECT run_id, count(*) FILTER (weight IS NULL) AS a, count(*) FILTER (weight < 0 OR weight > 1) AS b, sum(weight) AS s FROM w GROUP BY 1)
SELECT run_id, CASE WHEN a > 0 THEN 'not_finite' WHEN b > 0 THEN 'out_of_range' ELSE 'sum_above_one' END AS problem FROM g WHERE a > 0 OR b > 0 OR s > 1 + 1e-9""",
    "prediction_weights": f"""WITH {SQL_BARS}, {_SCORE}, k AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, symbol) AS k FROM s WHERE score > 0)
SELECT trade_date, symbol, round(least(score / sum(score) OVER d * 0.9, least(0.1, 0.9 / count(*) OVER d)), 6) + 0.0 AS weight FROM k WHERE k <= 12 WINDOW d AS (PARTITION BY trade_date)""",
    "advisory_outcomes": f"""WITH {_weights_sql(ALL['momentum_rank'])}, grid AS {SQL_GRID[SQL_GRID.index('grid AS') + 8:]}, {SQL_INDEX}, ax AS (SELECT trade_date, close AS ix, row_number() OVER (ORDER BY trade_date) AS i FROM index_bars),
st AS (SELECT w.decision_date, i AS i0, ix AS x0 FROM (SELECT DISTINCT decision_date FROM weights) w JOIN ax ON ax.trade_date = w.decision_date),
pa AS (SELECT decision_date, ax.trade_date, i - i0 AS step, ix / x0 AS b FROM st JOIN ax ON i BETWEEN i0 AND i0 + 20),
e AS (SELECT pa.decision_date, step, b, w.weight, g.close, g0.close AS c0 FROM pa JOIN weights w USING (decision_date) LEFT JOIN grid g ON g.symbol = w.symbol AND g.trade_date = pa.trade_date LEFT JOIN grid g0 ON g0.symbol = w.symbol AND g0.trade_date = pa.decision_date),
dy AS (SELECT decision_date, step, sum(weight * close / nullif(c0, 0)) + 1 - sum(weight) AS v, count(*) FILTER (close IS NULL OR c0 IS NULL) AS gone, any_value(b) AS b FROM e GROUP BY 1, 2),
ru AS (SELECT *, max(v) OVER d AS peak, sum(gone) OVER d AS missing FROM dy WINDOW d AS (PARTITION BY decision_date ORDER BY step)), rw AS (SELECT *, min(v / nullif(peak, 0) - 1) OVER (PARTITION BY decision_date ORDER BY step) AS worst FROM ru)
SELECT decision_date, step AS horizon, CASE WHEN missing = 0 THEN 'done' ELSE 'pending' END AS status, CASE WHEN missing = 0 THEN round(v - 1, 6) + 0.0 END AS "return", CASE WHEN missing = 0 THEN round(worst, 6) + 0.0 END AS drawdown,
CASE WHEN missing = 0 THEN round(v - b, 6) + 0.0 END AS excess FROM rw WHERE step IN (1, 5, 20)""",
    "advisory_expiry": f"""WITH {_weights_sql(ALL['momentum_rank'])}, la AS (SELECT symbol, max(trade_date) AS last FROM bars GROUP BY 1), dd AS (SELECT DISTINCT decision_date FROM weights),
nd AS (SELECT decision_date, min(trade_date) AS day FROM dd JOIN (SELECT DISTINCT trade_date FROM bars) ON trade_date > decision_date AND trade_date <= decision_date + 14 GROUP BY 1)
SELECT CAST(w.decision_date AS VARCHAR) AS advice_id, coalesce(count(*) FILTER (last IS NULL) = 0 AND min(last) > any_value(nd.day), false) AS expired FROM weights w LEFT JOIN la USING (symbol) LEFT JOIN nd ON nd.decision_date = w.decision_date GROUP BY w.decision_date""",
    "run_ranking": f"WITH {_RUNS} SELECT run_id, round(annual_return * 100 + sharpe * 10 - abs(max_drawdown) * 40 + stressed_sharpe * 5, 6) + 0.0 AS score FROM r ORDER BY annual_return * 100 + sharpe * 10 - abs(max_drawdown) * 40 + stressed_sharpe * 5 DESC, run_id LIMIT 100",
    "run_eligibility": """WITH c AS (SELECT c_name AS run_id, c_custkey AS k FROM customer), f AS (SELECT run_id,
  CASE WHEN k % 5 = 0 THEN 'source backtest was not built from a point-in-time research universe' END AS a, CASE WHEN k % 5 <> 0 AND k % 11 = 0 THEN 'local trading calendar has no dates for the recorded backtest range' END AS b,
  CASE WHEN k % 7 = 0 THEN 'local benchmark does not cover every OOS window boundary' END AS c, CASE WHEN k % 8 < 3 THEN 'fewer than the requested number of independent OOS windows were available' END AS d,
  CASE WHEN k % 37 * 9 < 126 THEN 'fewer than 126 OOS trading days were available' END AS e FROM c)
SELECT run_id, CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN 'not_eligible_pit_degraded' WHEN c IS NOT NULL THEN 'not_eligible_benchmark_missing' WHEN d IS NOT NULL OR e IS NOT NULL THEN 'not_eligible_insufficient_oos_history' ELSE 'eligible' END AS status,
  array_to_string(list_filter([a, b, c, d, e], lambda x: x IS NOT NULL), '; ') AS flags FROM f""",
    "variant_comparison": f"""WITH {_RUNS}, l AS (UNPIVOT (SELECT run_id, annual_return, sharpe, max_drawdown FROM r) ON annual_return, sharpe, max_drawdown INTO NAME metric VALUE v)
SELECT metric, round(max(v) FILTER (run_id = 'Customer#000000003'), 6) + 0.0 AS base, round(max(v) FILTER (run_id = 'Customer#000000008'), 6) + 0.0 AS other,
round(max(v) FILTER (run_id = 'Customer#000000008') - max(v) FILTER (run_id = 'Customer#000000003'), 6) + 0.0 AS delta FROM l GROUP BY 1""",
    "promotion_eligibility": """WITH r AS (SELECT c_custkey AS run_id, c_mktsegment AS seg, CASE WHEN c_custkey % 5 <> 0 THEN 'p' || c_custkey END AS p FROM customer),
v AS (SELECT o_orderkey AS k, o_custkey AS run_id, seg, p, CASE WHEN o_orderkey % 13 = 0 THEN 'other' ELSE seg END AS spec, CASE WHEN o_orderkey % 23 <> 0 THEN CAST(o_orderdate AS DATE) ELSE DATE '1999-01-01' END AS d FROM orders JOIN r ON run_id = o_custkey),
a AS (SELECT *, CASE WHEN k % 31 = 0 THEN 'other' ELSE spec END AS strategy, k % 6 <> 0 AS ev, CASE WHEN k % 10 = 0 THEN 0 WHEN k % 14 = 0 THEN 2000000000 - k ELSE k END AS vid FROM v),
f AS (SELECT *, ev AND vid = k AS there, ev AND vid = k AND p IS NOT NULL AS src, CASE WHEN k % 15 = 0 THEN 0 ELSE k % 5 + 1 END AS n FROM a),
g AS (SELECT *, src AND (n = 0 OR (k % 41 <> 7 AND NOT (n > 1 AND k % 31 = 5 AND k % 37 <> 3))) AS win FROM f),
h AS (SELECT *, win AND n > 0 AND (CASE WHEN k % 31 = 5 THEN 1 ELSE 0 END - CASE WHEN k % 37 = 3 THEN 1 ELSE 0 END) <> 0 AS shifted,
  strategy = seg AND spec = strategy AND k % 17 <> 0 AND k % 19 <> 0 AND k % 11 <> 0 AND k % 29 <> 0 AS same FROM g)
SELECT k AS advice_id, len(rs) = 0 AS eligible, validation_id, oos_window_count, rs AS reasons FROM (SELECT k, CASE WHEN ev AND vid >= 1 THEN vid END AS validation_id, CAST(CASE WHEN win THEN n ELSE 0 END AS BIGINT) AS oos_window_count, list_filter([
  CASE WHEN k % 4 = 0 OR k % 9 = 0 THEN '%(review)s' END, CASE WHEN k % 8 = 1 THEN '%(expired)s' END, CASE WHEN NOT ev THEN '%(no_evidence)s' END, CASE WHEN ev AND vid < 1 THEN '%(bad_id)s' END,
  CASE WHEN ev AND vid >= 1 AND vid <> k THEN '%(gone)s' END, CASE WHEN there AND (k % 7 = 0 OR k % 3 = 0) THEN '%(not_eligible)s' END, CASE WHEN there AND NOT src THEN '%(no_source)s' END, CASE WHEN src AND NOT win THEN '%(bad_windows)s' END,
  CASE WHEN win AND n < 3 THEN '%(few_windows)s' END, CASE WHEN shifted THEN '%(late_window)s' END, CASE WHEN win AND NOT same THEN '%(mismatch)s' END], lambda x: x IS NOT NULL) AS rs FROM h)""".replace(" % ", " %% ") % paper.REASONS,
    "portfolio_snapshot": f"""WITH {SQL_BARS}, t AS (SELECT symbol, close, 0.9 * (CAST(symbol AS INT) % 7 + 1) / 8 / 40 AS w FROM bars WHERE trade_date = DATE '{AS_OF}' AND CAST(symbol AS INT) % 2 = 0),
q AS (SELECT symbol, close, CAST(floor(50000000.0::DOUBLE * w / close / 100) * 100 AS BIGINT) AS quantity FROM t), h AS (SELECT * FROM q WHERE quantity > 0),
o AS (SELECT round(sum(100 * close), 2) AS v FROM bars WHERE trade_date = DATE '1997-01-27' AND CAST(symbol AS INT) % 3 = 0), e AS (SELECT round(sum(quantity * close), 2) AS v, round(50000000 - sum(quantity * close), 2) AS c FROM h)
SELECT DATE '1997-01-27' AS as_of, round(v, 1) AS position_value, round(v + 1000, 1) AS equity, NULL AS symbol, NULL AS quantity, NULL AS price FROM o
UNION ALL SELECT DATE '{AS_OF}', round(v, 1), round(v + c, 1), symbol, quantity, round(close, 4) FROM e, h""",
    "validation_cemetery": """WITH v AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 13 = 0 THEN 'other' ELSE c_mktsegment END AS s FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 3 = 0)
SELECT 'strategy' AS research_type, s AS subject_name, CAST(k AS VARCHAR) AS source_ref, 'v' || k AS source_fingerprint,
  coalesce(nullif(array_to_string(list_filter([CASE WHEN k % 2 = 0 THEN 'too few windows' END, CASE WHEN k % 5 = 0 THEN 'stale' END], lambda x: x IS NOT NULL), '; '), ''), 'watch') AS reason FROM v""",
    "ml_feature_matrix": f"""WITH {SQL_BASE}, p AS (SELECT symbol, trade_date, lead(close, 6) OVER w / nullif(lead(close, 1) OVER w, 0) - 1 AS fwd_5d, lead(close, 11) OVER w / nullif(lead(close, 1) OVER w, 0) - 1 AS fwd_10d,
  {', '.join(f'round({FACTOR_SQL[n]}, 8) * {f.direction} AS {n}' for n, f in REGISTRY.items())} FROM b3 {SQL_WINDOWS}),
me AS (SELECT trade_date, {', '.join(f'median({n}) AS m_{n}' for n in REGISTRY)} FROM p GROUP BY 1),
de AS (SELECT trade_date, {', '.join(f'median(abs({n} - m_{n})) AS d_{n}' for n in REGISTRY)} FROM p JOIN me USING (trade_date) GROUP BY 1)
SELECT trade_date, symbol, round(fwd_5d, 4) + 0.0 AS fwd_5d, round(fwd_10d, 4) + 0.0 AS fwd_10d,
  {', '.join(f'round(CASE WHEN d_{n} = 0 THEN {n} - m_{n} WHEN {n} IS NOT NULL THEN (greatest(m_{n} - d_{n} * 1.4826 * 3, least(m_{n} + d_{n} * 1.4826 * 3, {n})) - m_{n}) / (d_{n} * 1.4826) END, 4) + 0.0 AS {n}' for n in REGISTRY)}
FROM p JOIN me USING (trade_date) JOIN de USING (trade_date)""",
    "ml_dataset": f"""WITH {SQL_BASE}, m0 AS (SELECT symbol, trade_date, {', '.join(f'{FACTOR_SQL[n]} AS {n}' for n in NAMES)}, lead(close, 6) OVER w / nullif(lead(close, 1) OVER w, 0) - 1 AS fwd_5d FROM b3 {SQL_WINDOWS}),
{_mad('m0', NAMES[0], 'm1x')}, {_mad('m1x', NAMES[1], 'm2x')}, {_mad('m2x', NAMES[2], 'm3x')}
SELECT trade_date, symbol, round(-z_volatility_20d, 6) + 0.0 AS volatility_20d, round(z_momentum_20d, 6) + 0.0 AS momentum_20d, round(z_amount_stability_20d, 6) + 0.0 AS amount_stability_20d, round(fwd_5d, 6) + 0.0 AS fwd_5d FROM m3x
WHERE z_volatility_20d IS NOT NULL AND z_momentum_20d IS NOT NULL AND z_amount_stability_20d IS NOT NULL AND fwd_5d IS NOT NULL""",
    "ml_windows": f"""WITH {SQL_BARS}, e AS (SELECT date_trunc('month', min(trade_date)) AS lo, max(trade_date) AS hi FROM bars), s AS (SELECT hi, unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS t FROM e),
k AS (SELECT *, row_number() OVER (ORDER BY t) - 1 AS window_id FROM s) SELECT window_id, CAST(t AS DATE) AS train_start, CAST(t + INTERVAL 12 MONTH - INTERVAL 16 DAY AS DATE) AS train_end, CAST(t + INTERVAL 12 MONTH AS DATE) AS valid_start,
CAST(t + INTERVAL 14 MONTH - INTERVAL 16 DAY AS DATE) AS valid_end, CAST(t + INTERVAL 14 MONTH AS DATE) AS test_start, CAST(t + INTERVAL 15 MONTH - INTERVAL 1 DAY AS DATE) AS test_end FROM k WHERE t + INTERVAL 15 MONTH <= hi + INTERVAL 1 DAY""",
    "ml_rank_ic": f"""WITH {SQL_GRID}, {_SCORE}, y AS (SELECT symbol, trade_date, round(lead(close, 6) OVER w / nullif(lead(close, 1) OVER w, 0) - 1, 8) AS y FROM grid WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)),
j AS (SELECT trade_date, symbol, score AS x, y FROM s JOIN y USING (trade_date, symbol) WHERE score IS NOT NULL AND y IS NOT NULL),
k AS (SELECT *, rank() OVER (PARTITION BY trade_date ORDER BY x) + (count(*) OVER (PARTITION BY trade_date, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY trade_date ORDER BY y) + (count(*) OVER (PARTITION BY trade_date, y) - 1) / 2.0 AS ry FROM j)
SELECT trade_date, count(*) AS n, round(covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0), 6) + 0.0 AS ic, round(covar_samp(rx, ry) / nullif(stddev_samp(rx) * stddev_samp(ry), 0), 6) + 0.0 AS rank_ic
FROM k GROUP BY 1 HAVING count(DISTINCT x) >= 2 AND count(DISTINCT y) >= 2""",
    "ml_score_rank": f"""WITH {SQL_BARS}, {_SCORE}, f AS (SELECT s.trade_date AS decision_date, s.symbol, score FROM s JOIN bars b USING (trade_date, symbol) WHERE score >= 0 AND b.amount >= 60000
  AND (CAST(s.symbol AS INT) + month(s.trade_date)) % 11 <> 0 AND (CAST(s.symbol AS INT) + year(s.trade_date)) % 13 <> 0)
SELECT decision_date, symbol, round(score, 8) + 0.0 AS score, row_number() OVER (PARTITION BY decision_date ORDER BY score DESC, symbol) AS rank FROM f""",
}
