"""Table upkeep on Parquet: merges, range replacement, append logs, exports, fingerprints."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows without a fresh version, and the fresh rows."""
    return stored.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)


def replace_range(stored: DataFrame, fresh: DataFrame, symbols: list[str], start: str, end: str) -> DataFrame:
    """Stored bars outside symbols x range, and the fresh ones; fresh rows of other symbols or dates are left out."""
    inside = F.col("symbol").isin(symbols) & F.col("trade_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return stored.where(~inside).unionByName(fresh.where(inside))


def write_bars(bars: DataFrame, path: str) -> None:
    """Bars by year of trading, so that ranges prune folders; a rewritten year replaces its own folder alone."""
    (bars.withColumn("year", F.year("trade_date")).repartition("year").sortWithinPartitions("symbol", "trade_date")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path))


def append_once(stored: DataFrame, fresh: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Fresh rows whose fingerprint isn't stored yet: a rerun appends nothing."""
    return fresh.dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def write_text(df: DataFrame, path: str, kind: str = "csv") -> None:
    """CSV with a header, or JSON lines."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)


def markdown(df: DataFrame, limit: int = 50) -> str:
    """The first rows of a report table as Markdown."""
    rows = df.limit(limit).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows])


def fingerprint(spec: dict) -> str:
    """SHA-256 of canonical JSON: sorted keys, no blanks."""
    return hashlib.sha256(json.dumps(spec, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str).encode()).hexdigest()


def content_fingerprint(bars: DataFrame) -> str:
    """Order-free digest of a bar table: rows are hashed where they lie, only sums come back."""
    text = F.concat_ws("|", "symbol", "trade_date", *(F.format_string("%.17g", F.col(c)) for c in ("open", "high", "low", "close", "volume", "amount")))
    parts = [F.sum(F.conv(F.substring(F.sha2(text, 256), k, 12), 16, 10).cast("decimal(20,0)")).alias(f"p{k}") for k in (1, 13, 25, 37)]
    row = bars.agg(F.count(F.lit(1)).alias("n"), *parts).first()
    return hashlib.sha256("|".join(map(str, row)).encode()).hexdigest()
