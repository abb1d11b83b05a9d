"""Queries of the bar and security store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import desk as D
from tessera.operators import repository as R
from tessera.sources.tables import SQL_BARS, SQL_INDEX, SQL_STOCKS, bars, index_bars, load, stocks

START, END = "1996-01-01", "2000-12-31"


def _long(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).cast("long").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in df.dtypes))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job log: each order is a sync of a supplier, its status the order's."""
    o = load(spark, sf_dir, "orders")
    target = F.lpad((F.col("o_custkey") % 400 + 1).cast("string"), 6, "0")
    status = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "P", "empty").otherwise("failed")
    return o.select(F.col("o_orderkey").alias("job_id"), target.alias("target"), status.alias("status"), F.col("o_orderdate").cast("date").alias("created_at"))


def bars_scan(spark, sf_dir):
    """Three symbols in a range."""
    return R.daily_bars(bars(spark, sf_dir), ["000001", "000002", "000007"], START, END)


def index_scan(spark, sf_dir):
    """The index in a range."""
    return R.daily_bars(index_bars(spark, sf_dir), ["000300"], START, END)


def stock_search(spark, sf_dir):
    """Keyword search."""
    return R.search(stocks(spark, sf_dir), "00001", 20).select("symbol", "name", "exchange")


def symbol_normalizer(spark, sf_dir):
    """Codes in several spellings."""
    s = load(spark, sf_dir, "supplier")
    k = F.col("s_suppkey").cast("string")
    raw = F.element_at(F.array(F.concat(F.lit(" sh."), k), F.concat(F.lpad(k, 6, "0"), F.lit(".SZ")), k, F.concat(F.lit("X"), k)), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return s.select("s_suppkey", raw.alias("raw")).select("s_suppkey", "raw", R.normalize_symbol(F.col("raw")).alias("symbol"), R.exchange_of(R.normalize_symbol(F.col("raw"))).alias("exchange"))


def symbol_resolver(spark, sf_dir):
    """Codes, names and fragments to symbols."""
    s = stocks(spark, sf_dir)
    texts = s.select(F.when(F.col("symbol") % 2 == 0, F.col("symbol")).when(F.col("symbol") % 3 == 0, F.col("name")).otherwise(F.substring("name", 5, 30)).alias("text"))
    return R.resolve(s, texts)


def bar_counts(spark, sf_dir):
    """Bars per symbol in a range."""
    return R.daily_bars(bars(spark, sf_dir), None, START, END).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_bars"))


def coverage(spark, sf_dir):
    """Coverage per symbol."""
    return R.coverage(bars(spark, sf_dir))


def market_overview(spark, sf_dir):
    """The whole store."""
    return R.market_overview(bars(spark, sf_dir))


def covered_symbols(spark, sf_dir):
    """Securities whose bars span the range."""
    return R.covered_symbols(stocks(spark, sf_dir), bars(spark, sf_dir), START, END)


def sync_progress(spark, sf_dir):
    """Covered share."""
    return R.sync_progress(stocks(spark, sf_dir), bars(spark, sf_dir), jobs(spark, sf_dir), START, END)


def full_market_progress(spark, sf_dir):
    """The same with risk names."""
    return R.sync_progress(stocks(spark, sf_dir), bars(spark, sf_dir), jobs(spark, sf_dir), START, END, drop_risk=False)


def next_incomplete_symbols(spark, sf_dir):
    """Ten securities without a finished job in the whole log."""
    return R.next_symbols(stocks(spark, sf_dir), jobs(spark, sf_dir), 10)


def consecutive_failures(spark, sf_dir):
    """Failure streaks."""
    return R.consecutive_failures(jobs(spark, sf_dir))


def data_quality(spark, sf_dir):
    """Gaps per symbol."""
    q = R.data_quality(bars(spark, sf_dir), index_bars(spark, sf_dir))
    return q.select("symbol", "expected", "present", "missing", F.concat_ws(",", F.transform("first_missing", lambda d: d.cast("string"))).alias("first_missing"))


def data_quality_totals(spark, sf_dir):
    """Gaps in all."""
    return R.quality_totals(R.data_quality(bars(spark, sf_dir), index_bars(spark, sf_dir)))


def research_symbols(spark, sf_dir):
    """Securities with enough bars."""
    b = bars(spark, sf_dir)
    return R.select_research_symbols(stocks(spark, sf_dir), b, b.select("trade_date").distinct(), START, END, limit=30)


def pool_diagnostics(spark, sf_dir):
    """The eligible pool."""
    return R.pool_diagnostics(stocks(spark, sf_dir), bars(spark, sf_dir), START, END)


def active_symbols(spark, sf_dir):
    """Active securities of the exchanges."""
    return R.eligible_stocks(stocks(spark, sf_dir), ("SH", "SZ", "BJ"), drop_risk=False).select("symbol", "exchange").orderBy("symbol").limit(R.MOST_SYMBOLS)


def risk_name_filter(spark, sf_dir):
    """Securities without risk names."""
    return R.eligible_stocks(stocks(spark, sf_dir)).select("symbol", "name")


def amount_bands(spark, sf_dir):
    """Symbols by band of an amount: their mean amount, spread over the bands by symbol."""
    mean = bars(spark, sf_dir).groupBy("symbol").agg(F.avg("amount").alias("m")).withColumn("m", F.col("m") * 10 * F.pow(F.lit(4.0), F.col("symbol").cast("int") % 5 - 2))
    return mean.groupBy(R.amount_band(F.col("m")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


def _damaged(spark, sf_dir):
    b = bars(spark, sf_dir)
    k = F.datediff("trade_date", F.lit("1995-01-02").cast("date")) / 14 + F.col("symbol").cast("int")
    return b.withColumns({"close": F.when(k % 11 == 0, F.lit(None)).when(k % 13 == 0, -F.col("close")).otherwise(F.col("close")), "high": F.when(k % 17 == 0, F.col("low") / 2).otherwise(F.col("high"))})


def bar_validation(spark, sf_dir):
    """Rows that break a rule, in bars damaged by a rule of their own."""
    return R.bar_violations(_damaged(spark, sf_dir)).select("symbol", "trade_date", "rule")


def bar_errors(spark, sf_dir):
    """The error that each security's bars raise: damage that some securities are spared."""
    k = F.col("symbol").cast("int")
    b, d = bars(spark, sf_dir), _damaged(spark, sf_dir)
    mended = d.withColumn("close", F.when(F.col("close").isNull() | (k % 4 == 1), F.col("open")).otherwise(F.col("close"))).where(k % 3 != 0)
    return R.bar_errors(b.where(k % 6 == 0).unionByName(d.where(k % 6 == 3)).unionByName(mended), "feed")


def _calendar(spark, sf_dir):
    """Every day of the orders as a calendar; weekends are closed."""
    days = load(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("trade_date")).distinct()
    return days.withColumn("is_open", ~F.dayofweek("trade_date").isin(1, 7))


def trading_dates(spark, sf_dir):
    """Open days of two years, after some days were stated anew."""
    c = _calendar(spark, sf_dir)
    fresh = c.where(F.dayofmonth("trade_date") == 15).withColumn("is_open", F.month("trade_date") % 2 == 0)
    return D.trading_dates(D.upsert_calendar(c, fresh.unionByName(fresh)), "1996-01-01", "1997-12-31")


def sync_exits(spark, sf_dir):
    """What each month's batch of the job log leads to, and whether a watcher stops."""
    log = jobs(spark, sf_dir).groupBy(F.trunc("created_at", "month").alias("batch")).agg(
        F.count_if(F.col("status") != "failed").alias("processed"), F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "failed").alias("remaining"), F.max("job_id").alias("last"))
    k = F.month("batch")
    told = log.withColumns({"processed": F.when(k % 3 == 0, 0).otherwise(F.col("processed")), "remaining": F.when(k == 7, 0).otherwise(F.col("remaining"))})
    reason = D.exit_reason(F.col("remaining"), F.col("total") == 0, (F.col("processed") == 0) & (k % 2 == 0), F.col("processed"))
    return told.withColumn("reason", reason).withColumn("s", D.stop_watching(F.col("reason"), F.col("remaining"), F.col("last") % 3)).select("batch", "reason", "s.stop", "s.why")


def latest_jobs(spark, sf_dir):
    """The newest jobs of one target."""
    return D.latest(jobs(spark, sf_dir), {"target": "000007"}, "created_at", "job_id", 20)


def news_sync_symbols(spark, sf_dir):
    """Securities whose news is synced: the research pool, or all covered ones where it is empty, as it is with a limit that none meets."""
    pool = R.select_research_symbols(stocks(spark, sf_dir), bars(spark, sf_dir), bars(spark, sf_dir).select("trade_date").distinct(), START, END, least=15, share=2.0)
    covered = R.covered_symbols(stocks(spark, sf_dir), bars(spark, sf_dir), START, END)
    return D.snapshot_universe("market", None, D.first_that_has_rows(pool.where("n_bars > 100000").select("symbol"), covered.select("symbol")))


QUERIES = {f.__name__: f for f in (
    bars_scan, index_scan, stock_search, symbol_normalizer, symbol_resolver, bar_counts, coverage, market_overview, covered_symbols, sync_progress,
    full_market_progress, next_incomplete_symbols, consecutive_failures, data_quality, data_quality_totals, research_symbols, pool_diagnostics,
    active_symbols, risk_name_filter, amount_bands, bar_validation, bar_errors, trading_dates, sync_exits, latest_jobs, news_sync_symbols)}

_RANGE = f"trade_date BETWEEN DATE '{START}' AND DATE '{END}'"
_OK = "status = 'active' AND exchange IN ('SH', 'SZ')"
_NAME = r"NOT regexp_matches(name, '^(ST|\*ST|SST|S\*ST)') AND NOT contains(name, '退')"
_JOBS = """jobs AS (SELECT o_orderkey AS job_id, lpad(CAST(o_custkey % 400 + 1 AS VARCHAR), 6, '0') AS target,
  CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'P' THEN 'empty' ELSE 'failed' END AS status, CAST(o_orderdate AS DATE) AS created_at FROM orders)"""
_COV = f"cov AS (SELECT symbol, min(trade_date) AS first_date, max(trade_date) AS last_date, count(*) AS n_bars FROM bars GROUP BY 1)"


def _progress(names: str) -> str:
    return f"""WITH {SQL_BARS}, {SQL_STOCKS}, {_JOBS}, {_COV}, m AS (SELECT symbol,
  symbol IN (SELECT target FROM jobs WHERE status <> 'failed') OR symbol IN (SELECT symbol FROM cov WHERE first_date <= DATE '{START}' AND last_date >= DATE '{END}') AS c
  FROM stocks WHERE {_OK}{names})
SELECT count(*) AS total, count(*) FILTER (c) AS covered, CASE WHEN count(*) = 0 THEN 100.0 ELSE round(count(*) FILTER (c) * 100.0::DOUBLE / count(*), 2) END AS percent FROM m"""


_QUALITY = f"""WITH {SQL_BARS}, {SQL_INDEX}, days AS (SELECT DISTINCT trade_date FROM index_bars),
g AS (SELECT s.symbol, d.trade_date, b.symbol IS NOT NULL AS has FROM (SELECT DISTINCT symbol FROM bars) s CROSS JOIN days d LEFT JOIN bars b ON b.symbol = s.symbol AND b.trade_date = d.trade_date),
q AS (SELECT symbol, count(*) AS expected, count(*) FILTER (has) AS present, count(*) FILTER (NOT has) AS missing,
  coalesce(list(CAST(trade_date AS VARCHAR) ORDER BY trade_date) FILTER (NOT has), []) AS gone FROM g GROUP BY 1)"""
_CODE = r"""CASE WHEN regexp_matches(bare, '^[0-9]{1,6}$') THEN lpad(bare, 6, '0') END"""
ORACLE = {
    "bars_scan": f"WITH {SQL_BARS} SELECT * FROM bars WHERE symbol IN ('000001', '000002', '000007') AND {_RANGE}",
    "index_scan": f"WITH {SQL_INDEX} SELECT * FROM index_bars WHERE {_RANGE}",
    "stock_search": f"WITH {SQL_STOCKS} SELECT symbol, name, exchange FROM stocks WHERE contains(symbol, '00001') OR contains(upper(name), '00001') ORDER BY symbol LIMIT 20",
    "symbol_normalizer": rf"""WITH r AS (SELECT s_suppkey, ([' sh.' || s_suppkey, lpad(CAST(s_suppkey AS VARCHAR), 6, '0') || '.SZ', CAST(s_suppkey AS VARCHAR), 'X' || s_suppkey])[s_suppkey % 4 + 1] AS raw FROM supplier),
b AS (SELECT *, regexp_replace(upper(trim(raw)), '^(SH|SZ|BJ)\.?|\.?(SH|SZ|BJ|SS)$', '', 'g') AS bare FROM r), c AS (SELECT s_suppkey, raw, {_CODE} AS symbol FROM b)
SELECT *, CASE WHEN symbol LIKE '920%' THEN 'BJ' WHEN symbol[1] IN ('6', '9') THEN 'SH' WHEN symbol[1] IN ('0', '2', '3') THEN 'SZ' WHEN symbol[1] IN ('4', '8') THEN 'BJ' END AS exchange FROM c""",
    "symbol_resolver": rf"""WITH {SQL_STOCKS}, t AS (SELECT DISTINCT CASE WHEN CAST(symbol AS INT) % 2 = 0 THEN symbol WHEN CAST(symbol AS INT) % 3 = 0 THEN name ELSE substr(name, 5, 30) END AS text FROM stocks),
b AS (SELECT text, regexp_replace(upper(trim(text)), '^(SH|SZ|BJ)\.?|\.?(SH|SZ|BJ|SS)$', '', 'g') AS bare FROM t), c AS (SELECT text, {_CODE} AS code FROM b),
m AS (SELECT text, (SELECT max(symbol) FROM stocks WHERE symbol = code) AS by_code, (SELECT min(symbol) FROM stocks WHERE name = text) AS by_name,
  (SELECT count(*) FROM stocks WHERE contains(name, text)) AS n, (SELECT min(symbol) FROM stocks WHERE contains(name, text)) AS lk FROM c)
SELECT text, coalesce(by_code, by_name, CASE WHEN n = 1 THEN lk END) AS symbol,
  CASE WHEN by_code IS NOT NULL THEN 'code' WHEN by_name IS NOT NULL THEN 'name' WHEN n = 1 THEN 'contains' WHEN n > 1 THEN 'ambiguous' ELSE 'unknown' END AS rule FROM m""",
    "bar_counts": f"WITH {SQL_BARS} SELECT symbol, count(*) AS n_bars FROM bars WHERE {_RANGE} GROUP BY 1",
    "coverage": f"WITH {SQL_BARS}, {_COV} SELECT * FROM cov",
    "market_overview": f"WITH {SQL_BARS} SELECT count(*) AS n_bars, count(DISTINCT symbol) AS n_symbols, min(trade_date) AS first_date, max(trade_date) AS last_date FROM bars",
    "covered_symbols": f"WITH {SQL_BARS}, {SQL_STOCKS}, {_COV} SELECT symbol, name, first_date, last_date, n_bars FROM stocks JOIN cov USING (symbol) WHERE {_OK} AND {_NAME} AND first_date <= DATE '{START}' AND last_date >= DATE '{END}'",
    "sync_progress": _progress(f" AND {_NAME}"),
    "full_market_progress": _progress(""),
    "next_incomplete_symbols": f"WITH {SQL_STOCKS}, {_JOBS} SELECT symbol FROM stocks WHERE {_OK} AND {_NAME} AND symbol NOT IN (SELECT target FROM jobs WHERE status <> 'failed') ORDER BY 1 LIMIT 10",
    "consecutive_failures": f"""WITH {_JOBS}, r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY created_at DESC, job_id DESC) AS rn FROM jobs)
SELECT target, coalesce(min(rn) FILTER (status <> 'failed') - 1, count(*)) AS failures FROM r GROUP BY 1""",
    "data_quality": f"{_QUALITY} SELECT symbol, expected, present, missing, array_to_string(gone[1:20], ',') AS first_missing FROM q",
    "data_quality_totals": f"{_QUALITY} SELECT count(*) AS n_symbols, count(*) FILTER (missing = 0) AS complete, count(*) FILTER (missing > 0) AS with_gaps, CAST(sum(missing) AS BIGINT) AS missing_bars FROM q",
    "research_symbols": f"""WITH {SQL_BARS}, {SQL_STOCKS}, need AS (SELECT least(n, greatest(1, least(15, ceil(n * 0.8)))) AS need FROM (SELECT count(DISTINCT trade_date) AS n FROM bars WHERE {_RANGE})),
n AS (SELECT symbol, count(DISTINCT trade_date) AS n_bars FROM bars WHERE {_RANGE} GROUP BY 1)
SELECT symbol, n_bars FROM stocks JOIN n USING (symbol), need WHERE status = 'active' AND exchange IN ('SH', 'SZ', 'BJ') AND {_NAME} AND n_bars >= need ORDER BY n_bars DESC, symbol LIMIT 30""",
    "pool_diagnostics": f"""WITH {SQL_BARS}, {SQL_STOCKS}, e AS (SELECT symbol, count(*) AS n, min(trade_date) AS lo, max(trade_date) AS hi FROM bars WHERE {_RANGE} AND symbol IN (SELECT symbol FROM stocks WHERE {_OK} AND {_NAME}) GROUP BY 1)
SELECT count(*) AS eligible, min(lo) AS first_date, max(hi) AS last_date, CAST(sum(n) AS BIGINT) AS n_bars, (SELECT string_agg(symbol, ',') FROM (SELECT symbol FROM e ORDER BY n DESC, symbol LIMIT 5)) AS top5 FROM e""",
    "active_symbols": f"WITH {SQL_STOCKS} SELECT symbol, exchange FROM stocks WHERE status = 'active' ORDER BY symbol LIMIT 6000",
    "risk_name_filter": f"WITH {SQL_STOCKS} SELECT symbol, name FROM stocks WHERE {_OK} AND {_NAME}",
    "amount_bands": f"""WITH {SQL_BARS}, m AS (SELECT symbol, avg(amount) * 10 * pow(4.0, CAST(symbol AS INT) % 5 - 2) AS m FROM bars GROUP BY 1)
SELECT CASE WHEN m < 100000 THEN 'under_100k_cny' WHEN m < 500000 THEN '100k_to_500k_cny' WHEN m < 1000000 THEN '500k_to_1m_cny' WHEN m < 5000000 THEN '1m_to_5m_cny' ELSE 'over_5m_cny' END AS band, count(*) AS n FROM m GROUP BY 1""",
    "bar_errors": f"""WITH {SQL_BARS}, k AS (SELECT *, date_diff('day', DATE '1995-01-02', trade_date) / 14 + CAST(symbol AS INT) AS k, CAST(symbol AS INT) AS s FROM bars),
h AS (SELECT symbol, s, trade_date, open, low, CASE WHEN s % 6 = 0 THEN close WHEN k % 11 = 0 THEN CASE WHEN s % 3 <> 0 THEN open END WHEN s % 3 <> 0 AND s % 4 = 1 THEN open WHEN k % 13 = 0 THEN -close ELSE close END AS close,
  CASE WHEN s % 6 <> 0 AND k % 17 = 0 THEN low / 2 ELSE high END AS high, CAST(row_number() OVER (PARTITION BY symbol ORDER BY trade_date) - 1 AS INT) AS i FROM k),
e AS (SELECT symbol, list(i ORDER BY i) FILTER (close IS NULL) AS n, list(i ORDER BY i) FILTER (high <= 0) AS hp, list(i ORDER BY i) FILTER (close <= 0) AS cp, list(i ORDER BY i) FILTER (high < greatest(open, close, low)) AS hi, list(i ORDER BY i) FILTER (low > least(open, close, high)) AS lo FROM h GROUP BY 1),
t AS (SELECT *, '[' || array_to_string(n, ', ') || ']' AS ns, '[' || array_to_string(cp, ', ') || ']' AS cs, 'high < max(open, close, low) at row indices [' || array_to_string(hi, ', ') || ']' AS his, 'low > min(open, close, high) at row indices [' || array_to_string(lo, ', ') || ']' AS los FROM e)
SELECT symbol, CASE WHEN n IS NOT NULL THEN 'nan_value' WHEN cp IS NOT NULL THEN 'invalid_price' ELSE 'ohlc_contradiction' END AS kind, CASE WHEN n IS NOT NULL OR cp IS NOT NULL THEN 'close' ELSE 'high,low' END AS "column",
  CASE WHEN n IS NOT NULL THEN n WHEN cp IS NOT NULL THEN cp ELSE list_concat(coalesce(hi, []), list_filter(coalesce(lo, []), lambda x: NOT list_contains(coalesce(hi, []), x))) END AS row_indices,
  CASE WHEN n IS NOT NULL THEN 'feed: nan_value in close at row indices ' || ns WHEN cp IS NOT NULL THEN 'feed: invalid_price in close at row indices ' || cs ELSE 'feed: ' || concat_ws('; ', his, los) END AS message
FROM t WHERE coalesce(n, cp, hi, lo) IS NOT NULL""",
    "trading_dates": """WITH c AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) SELECT d AS trade_date FROM c WHERE d BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' AND CASE WHEN day(d) = 15 THEN month(d) % 2 = 0 ELSE dayofweek(d) NOT IN (0, 6) END""",
    "sync_exits": f"""WITH {_JOBS}, b AS (SELECT CAST(date_trunc('month', created_at) AS DATE) AS batch, count(*) FILTER (status <> 'failed') AS p, count(*) AS total, count(*) FILTER (status = 'failed') AS r, max(job_id) AS last FROM jobs GROUP BY 1),
t AS (SELECT batch, CASE WHEN month(batch) % 3 = 0 THEN 0 ELSE p END AS p, total, CASE WHEN month(batch) = 7 THEN 0 ELSE r END AS r, last FROM b),
x AS (SELECT *, CASE WHEN r = 0 OR total = 0 THEN 'completed' WHEN p = 0 AND month(batch) % 2 = 0 THEN 'blocked' WHEN p = 0 THEN 'idle' ELSE 'continue' END AS reason FROM t)
SELECT batch, reason, reason = 'completed' OR r = 0 OR (last % 3 = 0 AND reason <> 'continue') AS stop, CASE WHEN r = 0 THEN 'completed' ELSE reason END AS why FROM x""",
    "latest_jobs": f"WITH {_JOBS} SELECT * FROM jobs WHERE target = '000007' ORDER BY created_at DESC, job_id DESC LIMIT 20",
    "bar_validation": f"""WITH {SQL_BARS}, k AS (SELECT *, date_diff('day', DATE '1995-01-02', trade_date) / 14 + CAST(symbol AS INT) AS k FROM bars),
h AS (SELECT symbol, trade_date, open, low, volume, amount, CASE WHEN k % 11 = 0 THEN NULL WHEN k % 13 = 0 THEN -close ELSE close END AS close, CASE WHEN k % 17 = 0 THEN low / 2 ELSE high END AS high FROM k),
r AS (SELECT symbol, trade_date, CASE WHEN close IS NULL THEN 'missing_value' WHEN least(open, high, low, close) <= 0 THEN 'price_not_positive'
  WHEN high < greatest(open, close, low) OR low > least(open, close, high) THEN 'contradiction' END AS rule FROM h) SELECT * FROM r WHERE rule IS NOT NULL""",
}
# the pool of that query is empty by its limit, so the fallback answers
ORACLE["news_sync_symbols"] = f"SELECT symbol, true AS degraded, '{D.SNAPSHOT_WARNING}' AS warning FROM ({ORACLE['covered_symbols']})"
