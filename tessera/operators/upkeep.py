"""Upserts of point-in-time tables: words and intervals checked, rejects kept with reasons, placeholders retired, overlaps found."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.repository import normalize_symbol

# The words of the tables.
STATUSES = ("listed", "normal", "st", "sst", "st_star", "suspended", "delisted")
ST_STATUSES = ("normal", "st", "sst", "st_star")
GAP_TYPES = ("normal", "suspended", "limit_halt", "new_listing_gap", "delisted_gap", "provider_gap", "unknown")
CONFIDENCE = ("high", "medium", "low")
NAME_LENGTH = 64


@dataclass(frozen=True)
class Table:
    """What makes a table's rows: its key, the column of words and their list, whether rows span an interval, which columns are symbols."""

    key: tuple[str, ...]
    word: str | None = None
    words: tuple[str, ...] = ()
    interval: bool = True
    symbols: tuple[str, ...] = ("symbol",)


TABLES = {
    "security_status": Table(("symbol", "status", "valid_from"), "status", STATUSES),
    "security_st_status": Table(("symbol", "st_status", "valid_from"), "st_status", ST_STATUSES),
    "security_name": Table(("symbol", "valid_from")),
    "index_constituent": Table(("index_symbol", "symbol", "valid_from"), symbols=("index_symbol", "symbol")),
    "index_weight_snapshot": Table(("index_symbol", "symbol", "trade_date"), interval=False, symbols=("index_symbol", "symbol")),
    "security_trade_gap": Table(("symbol", "trade_date"), "gap_type", GAP_TYPES, interval=False),
}


def checked(rows: DataFrame, table: str) -> DataFrame:
    """The rows with normalised symbols and words, and ``reasons``: what a row is turned away for, empty where it is taken.

    bad_symbol, missing_date, unknown_word, unknown_confidence, empty_interval
    (an end not after the start). Words lose outer spaces and case; a missing
    confidence is high, a missing source unknown; names keep NAME_LENGTH
    characters.
    """
    t = TABLES[table]
    word = lambda c: F.lower(F.trim(F.col(c)))
    changes: dict[str, Column] = {c: normalize_symbol(F.col(c).cast("string")) for c in t.symbols}
    if t.word:
        changes[t.word] = word(t.word)
    if "confidence" in rows.columns:
        changes["confidence"] = F.coalesce(word("confidence"), F.lit("high"))
    if "source" in rows.columns:
        changes["source"] = F.coalesce("source", F.lit("unknown"))
    if "name" in rows.columns:
        changes["name"] = F.substring("name", 1, NAME_LENGTH)
    day = "valid_from" if t.interval else "trade_date"
    out = rows.withColumns(changes)
    tests = [
        F.when(F.greatest(*[F.col(c).isNull() for c in (*t.symbols, t.symbols[0])]), "bad_symbol"),
        F.when(F.col(day).isNull(), "missing_date"),
    ]
    if t.word:
        tests.append(F.when(~F.coalesce(F.col(t.word).isin(*t.words), F.lit(False)), "unknown_word"))
    if "confidence" in rows.columns:
        tests.append(F.when(~F.col("confidence").isin(*CONFIDENCE), "unknown_confidence"))
    if t.interval:
        tests.append(F.when(F.col("valid_to") <= F.col("valid_from"), "empty_interval"))
    return out.withColumn("reasons", F.array_compact(F.array(*tests)))


def rejects(rows: DataFrame, table: str) -> DataFrame:
    """The rows that an upsert turns away, with their reasons joined by a comma: a table of their own."""
    bad = checked(rows, table).where(F.size("reasons") > 0)
    return bad.withColumn("reasons", F.array_join("reasons", ","))


def upserted(stored: DataFrame, rows: DataFrame, table: str, order: str = "seq") -> DataFrame:
    """The table after its rows were merged in: of fresh rows with one key the last by ``order`` counts and replaces the stored one.

    In security_status a real listing (high confidence, announced on its own
    day) retires the placeholders that were there before it: listed rows of
    the same security that start later, have medium confidence and no
    announcement. Rows that ``checked`` turns away change nothing.

    One exchange by security serves the key and the placeholders alike.
    """
    t = TABLES[table]
    good = checked(rows, table).where(F.size("reasons") == 0)
    columns = stored.columns
    fresh = good.select(*(F.col(c).cast(stored.schema[c].dataType).alias(c) for c in columns), F.col(order).cast("long").alias("_seq"))
    both = stored.select(*columns, F.lit(-1).cast("long").alias("_seq")).unionByName(fresh)
    # one partitioning for both windows: the key's first column is the security
    last = Window.partitionBy(*t.key).orderBy(F.desc("_seq"))
    kept = both.withColumns({"_rn": F.row_number().over(last), "_first": F.min(F.when(F.col("_seq") >= 0, F.col("_seq"))).over(Window.partitionBy(*t.key))}).where("_rn = 1")
    if table == "security_status":
        real = (F.col("_seq") >= 0) & (F.col("status") == "listed") & (F.col("confidence") == "high") & (F.col("announced_at") == F.col("valid_from"))
        # a row takes the place in which its key was first met
        kept = kept.withColumn("_place", F.coalesce("_first", F.lit(-1)))
        after = Window.partitionBy("symbol").orderBy("_place").rangeBetween(1, Window.unboundedFollowing)
        kept = kept.withColumn("_real", F.min(F.when(real, F.col("valid_from"))).over(after))
        placeholder = (F.col("status") == "listed") & (F.col("confidence") == "medium") & F.col("announced_at").isNull()
        kept = kept.where(~F.coalesce(placeholder & (F.col("valid_from") > F.col("_real")), F.lit(False)))
    return kept.select(*columns)


def spans(rows: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Stretches of touching or overlapping intervals of each key, with the gap before each.

    by, span_from, span_to (null: open), n_rows, n_overlaps (rows that start
    before all earlier ones of the stretch have ended), gap_days since the
    stretch before. A running maximum of ends finds both in one ordering.
    """
    far = F.lit("9999-12-31").cast("date")
    w = Window.partitionBy(*by).orderBy("valid_from", "_to")
    ends = rows.select(*by, "valid_from", F.coalesce("valid_to", far).alias("_to")).withColumn("_before", F.max("_to").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    marked = ends.withColumns({"_new": F.col("_before").isNull() | (F.col("valid_from") > F.col("_before")), "_over": F.coalesce(F.col("valid_from") < F.col("_before"), F.lit(False))})
    islands = marked.withColumn("_span", F.count_if("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = islands.groupBy(*by, "_span").agg(
        F.min("valid_from").alias("span_from"), F.max("_to").alias("_to"), F.count(F.lit(1)).alias("n_rows"), F.count_if("_over").alias("n_overlaps"),
        F.max(F.when(F.col("_new"), F.datediff("valid_from", "_before"))).alias("gap_days"))
    return out.select(*by, "span_from", F.nullif("_to", far).alias("span_to"), "n_rows", "n_overlaps", "gap_days")
