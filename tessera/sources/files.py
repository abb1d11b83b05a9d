"""CSV and JSON inputs, provider frames, and the column normaliser."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.repository import normalize_score_symbol

# Column names that providers use, first match wins.
ALIASES: dict[str, tuple[str, ...]] = {
    "symbol": ("股票代码", "code", "symbol", "stock_code", "stockCode", "代码"),
    "trade_date": ("日期", "date", "trade_date", "time", "day", "tradeDate", "trade-date"),
    "open": ("开盘", "open", "开盘价", "open_price", "openPrice"),
    "high": ("最高", "high", "最高价", "high_price", "highPrice"),
    "low": ("最低", "low", "最低价", "low_price", "lowPrice"),
    "close": ("收盘", "close", "收盘价", "close_price", "closePrice"),
    "volume": ("成交量", "volume", "vol", "trade_volume", "tradeVolume"),
    "amount": ("成交额", "amount", "amt", "trade_amount", "tradeAmount"),
    "adj": ("复权类型", "adj", "adjust", "adjust_type", "adjustType", "复权"),
}
OPTIONAL = ("symbol", "adj")
SCHEMAS = {
    "scores": T.StructType([T.StructField("trade_date", T.DateType()), T.StructField("symbol", T.StringType()), T.StructField("score", T.DoubleType())]),
    "gaps": T.StructType([T.StructField("trade_date", T.DateType()), T.StructField("symbol", T.StringType()), T.StructField("gap_type", T.StringType())]),
    "news": T.StructType([
        T.StructField("symbol", T.StringType()), T.StructField("published_at", T.TimestampNTZType()), T.StructField("fetched_at", T.TimestampNTZType()), T.StructField("event_type", T.StringType()),
        T.StructField("sentiment_label", T.StringType()), T.StructField("sentiment_score", T.DoubleType()), T.StructField("relevance_score", T.DoubleType())]),
}


def normalize_columns(raw: DataFrame) -> DataFrame:
    """Canonical names for the columns that are known, others dropped; a missing canonical column is an error, but for symbol and adj."""
    found = {name: next((a for a in aliases if a in raw.columns), None) for name, aliases in ALIASES.items()}
    missing = [n for n, a in found.items() if a is None and n not in OPTIONAL]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return raw.select(*(F.col(f"`{a}`").alias(n) for n, a in found.items() if a))


def read_csv(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A CSV input by its schema; codes are strings of six digits. A header without a required column is an error."""
    schema = SCHEMAS[kind]
    header = spark.read.csv(path, header=True).columns
    missing = [f.name for f in schema if f.name not in header]
    if missing:
        raise ValueError(f"{path}: missing columns {missing}")
    text = T.StructType([T.StructField(c, T.StringType()) for c in header])
    raw = spark.read.schema(text).csv(path, header=True)
    return raw.select(*((normalize_score_symbol(F.col(f.name)) if f.name == "symbol" else F.col(f.name).try_cast(f.dataType)).alias(f.name) for f in schema))


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """run_id, trade_date, equity, drawdown, benchmark of a backtest report in JSON."""
    raw = spark.read.option("multiLine", True).json(path).select(F.posexplode("runs").alias("run_id", "run"))
    equity = raw.select("run_id", F.explode("run.equity_curve").alias("e")).select("run_id", F.col("e.trade_date").cast("date").alias("trade_date"), "e.equity", "e.drawdown")
    bench = raw.select("run_id", F.explode("run.benchmark_curve").alias("b")).select("run_id", F.col("b.trade_date").cast("date").alias("trade_date"), F.col("b.equity").alias("benchmark"))
    return equity.join(bench, ["run_id", "trade_date"], "left")


def parameter_grid(text: str) -> list[dict]:
    """A JSON list of parameter objects."""
    found = json.loads(text)
    if not isinstance(found, list) or not all(isinstance(x, dict) for x in found):
        raise ValueError("a parameter grid is a list of objects")
    return found


def parse_parameter(text: str) -> tuple[str, object]:
    """name=value with the value as bool, int, float or text."""
    name, sep, value = text.partition("=")
    if not sep or not name.strip():
        raise ValueError(f"not name=value: {text!r}")
    value = value.strip()
    if value.lower() in ("true", "false"):
        return name.strip(), value.lower() == "true"
    for kind in (int, float):
        try:
            return name.strip(), kind(value)
        except ValueError:
            pass
    return name.strip(), value
