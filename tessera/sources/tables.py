"""Loaders, and the views that give the star-schema tables the shape of market data.

Bars come from ``lineitem`` (symbol = supplier, one bar per 14 days), the index
from all suppliers together, securities from ``supplier``, news from ``events``
and bitemporal status intervals from ``orders``. Prices are rounded to six
decimals where they are made, just off the ties of that rounding, so every
later comparison sees the same numbers whatever order a sum was taken in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAR_SCHEMA = T.StructType([
    T.StructField("symbol", T.StringType(), False), T.StructField("trade_date", T.DateType(), False),
    *(T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume", "amount")),
])
EPOCH, STEP = "1995-01-02", 14
#: Added before rounding: prices over a power of two lie on exact ties, which engines round differently.
OFF_TIE = 3.3e-8


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the folder; filters and columns are pushed into its scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bin(ts: str):
    days = F.datediff(F.col(ts).cast("date"), F.lit(EPOCH).cast("date"))
    return F.date_add(F.lit(EPOCH).cast("date"), (F.floor(days / STEP) * STEP).cast("int"))


def _bar_columns(source: DataFrame, keys: list[str]) -> DataFrame:
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return source.groupBy(*keys, _bin("l_shipdate").alias("trade_date")).agg(
        *(F.round(x + OFF_TIE, 6).alias(n) for n, x in (
            ("open", F.avg(price)), ("high", F.max(price)), ("low", F.min(price)), ("close", F.sum("l_extendedprice") / F.sum("l_quantity")))),
        F.round(F.sum("l_quantity"), 6).alias("volume"), F.round(F.sum("l_extendedprice"), 4).alias("amount"),
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, trade_date, open, high, low, close, volume, amount."""
    lines = load(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    return _bar_columns(lines.withColumn("symbol", F.lpad(F.col("l_suppkey").cast("string"), 6, "0")), ["symbol"])


def index_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same bars over all suppliers."""
    lines = load(spark, sf_dir, "lineitem").select("l_shipdate", "l_extendedprice", "l_quantity")
    return _bar_columns(lines, []).select(F.lit("000300").alias("symbol"), "trade_date", "open", "high", "low", "close", "volume", "amount")


def stocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, name, exchange, list_date, status; every 17th security bears a risk prefix, every 29th is inactive."""
    key = F.col("s_suppkey")
    return load(spark, sf_dir, "supplier").select(
        F.lpad(key.cast("string"), 6, "0").alias("symbol"),
        F.when(key % 17 == 0, F.concat(F.lit("*ST "), F.col("s_name"))).when(key % 23 == 0, F.concat(F.col("s_name"), F.lit("退"))).otherwise(F.col("s_name")).alias("name"),
        F.element_at(F.array(F.lit("SH"), F.lit("SZ"), F.lit("BJ")), (F.col("s_nationkey") % 3 + 1).cast("int")).alias("exchange"),
        F.date_add(F.lit("1994-06-01").cast("date"), (key % 900).cast("int")).alias("list_date"),
        F.when(key % 29 == 0, "inactive").otherwise("active").alias("status"),
    )


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """news_id, source, symbol, event_type, sentiment_score, published_at, fetched_at, known_at."""
    e = load(spark, sf_dir, "events")
    published = F.col("ts").cast("timestamp_ntz")
    fetched = F.expr("cast(ts as timestamp_ntz) + make_interval(0, 0, 0, 0, cast(event_id % 72 as int), 0, 0)")
    return e.select(
        F.col("event_id").alias("news_id"), F.concat(F.lit("feed"), (F.col("event_id") % 3).cast("string")).alias("source"),
        F.lpad(F.col("user_id").cast("string"), 6, "0").alias("symbol"), "event_type", F.round("value", 6).alias("sentiment_score"),
        published.alias("published_at"), fetched.alias("fetched_at"),
    ).withColumn("known_at", F.greatest("published_at", "fetched_at"))


def status_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, status, valid_from, valid_to, announced_at: half-open intervals of each customer's orders."""
    o = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.col("o_orderdate").cast("date").alias("valid_from"))
    first = o.groupBy("o_custkey", "valid_from").agg(F.min(F.struct("o_orderkey", "o_orderstatus")).alias("o"))
    status = F.when(F.col("o.o_orderstatus") == "F", "st").when(F.col("o.o_orderstatus") == "P", "suspended").otherwise("normal")
    return first.select(
        F.lpad(F.col("o_custkey").cast("string"), 6, "0").alias("symbol"), status.alias("status"), "valid_from",
        F.lead("valid_from").over(Window.partitionBy("o_custkey").orderBy("valid_from")).alias("valid_to"),
        F.date_add("valid_from", (F.col("o.o_orderkey") % 30).cast("int")).alias("announced_at"),
    )


# The same views in DuckDB SQL, for the oracles.
_BAR = f"""round(avg(l_extendedprice / l_quantity) + {OFF_TIE}, 6) AS open, round(max(l_extendedprice / l_quantity) + {OFF_TIE}, 6) AS high,
  round(min(l_extendedprice / l_quantity) + {OFF_TIE}, 6) AS low, round(sum(l_extendedprice) / sum(l_quantity) + {OFF_TIE}, 6) AS close,
  round(sum(l_quantity), 6) AS volume, round(sum(l_extendedprice), 4) AS amount"""
_DATE = f"DATE '{EPOCH}' + CAST({STEP} * floor(date_diff('day', DATE '{EPOCH}', CAST(l_shipdate AS DATE)) / {STEP}) AS INT)"
SQL_BARS = f"bars AS (SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS symbol, {_DATE} AS trade_date, {_BAR} FROM lineitem GROUP BY 1, 2)"
SQL_INDEX = f"index_bars AS (SELECT '000300' AS symbol, {_DATE} AS trade_date, {_BAR} FROM lineitem GROUP BY 2)"
SQL_STOCKS = """stocks AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS symbol,
  CASE WHEN s_suppkey % 17 = 0 THEN '*ST ' || s_name WHEN s_suppkey % 23 = 0 THEN s_name || '退' ELSE s_name END AS name,
  (['SH', 'SZ', 'BJ'])[s_nationkey % 3 + 1] AS exchange, DATE '1994-06-01' + CAST(s_suppkey % 900 AS INT) AS list_date,
  CASE WHEN s_suppkey % 29 = 0 THEN 'inactive' ELSE 'active' END AS status FROM supplier)"""
SQL_NEWS = """news AS (SELECT *, greatest(published_at, fetched_at) AS known_at FROM (
  SELECT event_id AS news_id, 'feed' || CAST(event_id % 3 AS VARCHAR) AS source, lpad(CAST(user_id AS VARCHAR), 6, '0') AS symbol, event_type,
  round(value, 6) AS sentiment_score, CAST(ts AS TIMESTAMP) AS published_at, CAST(ts AS TIMESTAMP) + to_hours(CAST(event_id % 72 AS INT)) AS fetched_at FROM events))"""
SQL_STATUS = """status AS (SELECT lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS symbol,
  CASE s WHEN 'F' THEN 'st' WHEN 'P' THEN 'suspended' ELSE 'normal' END AS status, valid_from,
  lead(valid_from) OVER (PARTITION BY o_custkey ORDER BY valid_from) AS valid_to, valid_from + CAST(k % 30 AS INT) AS announced_at
  FROM (SELECT o_custkey, CAST(o_orderdate AS DATE) AS valid_from, min(o_orderkey) AS k, arg_min(o_orderstatus, o_orderkey) AS s FROM orders GROUP BY 1, 2))"""
