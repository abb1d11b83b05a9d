"""Point-in-time lookups: interval and as-of joins, universe waterfall, SCD-2 upkeep."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.repository import exchange_of
from tessera.operators.timeline import as_of_join, status_timeline, timeline_as_of

#: Length of the month-like cells that turn a range predicate into an equality.
CELL_DAYS = 64
OPEN_END = "9999-12-31"


def _day(name: str):
    return F.datediff(F.col(name), F.lit("1970-01-01").cast("date"))


def interval_join(asks: DataFrame, intervals: DataFrame, key: str = "symbol", as_of: str = "as_of", values: tuple[str, ...] = ("status",)) -> DataFrame:
    """The latest interval of each ask that is valid and announced at its time; nulls where there is none.

    valid_from <= t < valid_to (open if null) and coalesce(announced_at,
    valid_from) <= t. The announcement is tested before ranking, so a
    correction that is announced late never hides the row before it. Asks and
    intervals meet on the key; an interval that ends before its announcement
    is out from the start.
    """
    known = intervals.select(
        F.col(key).alias("_k"), "valid_from", F.coalesce("valid_to", F.lit(OPEN_END).cast("date")).alias("_to"),
        F.greatest(F.coalesce("announced_at", "valid_from"), "valid_from").alias("_since"), *values,
    ).where("_since < _to")
    ids = asks.select(key, as_of).distinct()
    hits = ids.join(known, (F.col(key) == F.col("_k")) & (F.col("_since") <= F.col(as_of)) & (F.col(as_of) < F.col("_to")))
    best = hits.groupBy(key, as_of).agg(F.max_by(F.struct("valid_from", *values), "valid_from").alias("_v"))
    return asks.join(best, [key, as_of], "left").select(*asks.columns, F.col("_v.valid_from").alias("valid_from"), *(F.col(f"_v.{c}").alias(c) for c in values))


def derive_intervals(events: DataFrame, key: str = "symbol", value: str = "status", at: str = "change_date", start: str = "normal") -> DataFrame:
    """Change events to intervals: leading ``start`` events go, equal neighbours merge, each ends where the next begins."""
    w = Window.partitionBy(key).orderBy(at)
    marked = events.withColumn("_before", F.lag(value).over(w))
    kept = marked.where(F.coalesce(F.col("_before"), F.lit(start)) != F.col(value))
    return kept.select(key, value, F.col(at).alias("valid_from"), F.lead(at).over(w).alias("valid_to"))


def reconcile(open_rows: DataFrame, desired: DataFrame, as_of: str, key: str = "symbol", value: str = "status") -> DataFrame:
    """SCD-2 step: what a snapshot does to the open rows.

    Unchanged rows stay; changed or vanished ones end at ``as_of``, or are
    removed if they began no earlier; new and changed values open at ``as_of``.
    """
    day = F.lit(as_of).cast("date")
    a = open_rows.select(key, F.col(value).alias("old"), "valid_from")
    b = desired.select(key, F.col(value).alias("new"))
    both = a.join(b, key, "full_outer")
    same = F.coalesce(F.col("old") == F.col("new"), F.lit(False))
    stays = both.where(same).select(key, F.col("old").alias(value), "valid_from", F.lit(None).cast("date").alias("valid_to"), F.lit("kept").alias("action"))
    ends = both.where(~same & F.col("old").isNotNull() & (F.col("valid_from") < day)).select(key, F.col("old").alias(value), "valid_from", day.alias("valid_to"), F.lit("closed").alias("action"))
    opens = both.where(~same & F.col("new").isNotNull()).select(key, F.col("new").alias(value), day.alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), F.lit("opened").alias("action"))
    return stays.unionByName(ends).unionByName(opens)


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the last in an order."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def pit_name_class(name):
    """st, sst, st_star, s_st_star for risk prefixes that end, or are followed by a space or a non-ASCII character; 退 is st_star; else normal."""
    prefix = F.regexp_extract(name, r"^\s*(\*ST|S\*ST|SST|ST)($|\s|[^\x00-\x7F])", 1)
    return F.when(prefix.isin("*ST", "S*ST"), "st_star").when(prefix == "SST", "sst").when(prefix == "ST", "st").when(name.contains("退"), "st_star").otherwise("normal")


def least_trading_days(start: str, end: str, calendar: DataFrame | None, least: int | None, share: float) -> tuple[int, int]:
    """Trading days expected in [start, end], and how many bars a security needs.

    Days are those of the calendar (trade_date; with is_open, open ones alone),
    without any five sevenths of the span. The need is ``least``, or ``share``
    of the days rounded up, never below 1 nor above the days.
    """
    days = 0
    if calendar is not None:
        open_ = calendar.where("is_open") if "is_open" in calendar.columns else calendar
        days = open_.where(F.col("trade_date").between(start, end)).agg(F.countDistinct("trade_date")).first()[0]
    if not days:
        span = max(1, (dt.date.fromisoformat(end) - dt.date.fromisoformat(start)).days + 1)
        days = max(1, round(span * 5.0 / 7.0))
    need = int(least) if least is not None else math.ceil(days * share)
    return days, max(1, min(need, days))


def market_candidates(stocks: DataFrame, status: DataFrame, as_of: str, exchanges: tuple[str, ...] = ("SH", "SZ")) -> DataFrame:
    """symbol of the securities of some exchanges: those of the master, and those that only the status table knows, of the exchange that their symbol tells."""
    past = status.where(F.col("valid_from") <= F.lit(as_of).cast("date")).select("symbol").distinct().join(stocks.select("symbol"), "symbol", "left_anti")
    return stocks.where(F.col("exchange").isin(*exchanges)).select("symbol").unionByName(past.where(exchange_of(F.col("symbol")).isin(*exchanges)))


def universe_waterfall(candidates: DataFrame, stocks: DataFrame, status: DataFrame, names: DataFrame, bars: DataFrame, as_of: str, lookback_days: int = 180, least_bars: int | None = 5,
                       exclude_st: bool = True, st_policy: str = "exclude_known", st_status: DataFrame | None = None, start: str | None = None, end: str | None = None,
                       calendar: DataFrame | None = None, least_share: float = 0.8, limit: int = 10_000) -> DataFrame:
    """One row a candidate: eligible, exclusion_reason (the first that applies: delisted, suspended, not_listed, st, no_bars), selected, and what was missing.

    Availability and risk are two axes, asked apart: a security may be listed
    and of a risk tier at the same time, or suspended whatever its tier. The
    risk axis is ``st_status`` with the tiers of the mixed table as fallback;
    only where neither has a row of the date does the date's name decide, and
    without a name st_policy "strict" takes the snapshot's name while the
    others keep the security. A security without any status row of the date
    falls back to the present snapshot; what happened later changes no past
    universe where history is known. Rows that used a fallback are degraded.

    Bars count in [start, end], by default the lookback_days up to as_of;
    ``least_trading_days`` says how many are needed. ``selected`` are the first
    ``limit`` (1 to 10,000) eligible ones by bars, then symbol.
    """
    if st_policy not in ("strict", "include_unknown", "exclude_known"):
        raise ValueError("st_policy is strict, include_unknown or exclude_known")
    day = F.lit(as_of).cast("date")
    end = end or as_of
    start = start or str(dt.date.fromisoformat(end) - dt.timedelta(lookback_days - 1))
    expected, need = least_trading_days(start, end, calendar, least_bars, least_share)
    asks = candidates.select("symbol").distinct().withColumn("as_of", day)
    then = timeline_as_of(asks, status_timeline(status, st_status, names)).drop("as_of", "status_from").withColumnsRenamed({"name": "pit_name", "status": "pit_status"})
    n = bars.where(F.col("trade_date").between(start, end)).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_bars"))
    out = then.join(stocks.select("symbol", F.col("name").alias("now_name"), F.col("status").alias("now")), "symbol", "left").join(n, "symbol", "left")
    known, n_bars = F.col("pit_status").isNotNull(), F.coalesce("n_bars", F.lit(0)).cast("long")
    checked = F.coalesce("pit_name", "now_name") if st_policy == "strict" else F.col("pit_name")
    by_name = F.col("st_status").isNull() & F.coalesce(pit_name_class(checked) != "normal", F.lit(False))
    risk = F.coalesce(F.col("st_status") != "normal", F.lit(False)) | by_name
    reason = (
        F.when(F.col("availability").isin("delisted", "suspended"), F.col("availability"))
        .when(~known & ~F.coalesce(F.col("now") == "active", F.lit(False)), "not_listed")
        .when(F.lit(exclude_st) & risk, "st").when(n_bars < need, "no_bars")
    )
    judged = out.select(
        "symbol", reason.isNull().alias("eligible"), reason.alias("exclusion_reason"), F.coalesce("pit_name", "now_name").alias("name"), F.coalesce("pit_status", "now").alias("status_at"),
        "availability", "st_status", n_bars.alias("n_bars"), (~known).alias("missing_status"), F.col("pit_name").isNull().alias("missing_name"), F.col("st_status").isNull().alias("missing_st"),
        (~known | (F.lit(exclude_st) & (F.col("pit_name").isNull() | F.col("st_status").isNull()))).alias("degraded"),
        F.lit(expected).alias("expected_trading_days"), F.lit(need).alias("least_trading_days"))
    first = judged.where("eligible").orderBy(F.desc("n_bars"), "symbol").limit(max(1, min(int(limit), 10_000))).select("symbol", F.lit(True).alias("_in"))
    return judged.join(first, "symbol", "left").withColumn("selected", F.coalesce("_in", F.lit(False))).drop("_in")


def index_members(constituents: DataFrame, weights: DataFrame, names: DataFrame, asks: DataFrame) -> DataFrame:
    """index_symbol, as_of, symbol, name, weight, valid_from, confidence of the members of an index at a date.

    ``constituents`` (index_symbol, symbol, valid_from, valid_to, announced_at)
    count as in ``interval_join``; the weight is the latest one on or before
    the date, the name that of the date. Confidence is medium without an
    announcement. ``asks`` holds index_symbol and as_of.
    """
    rows = constituents.withColumn("pair", F.struct("index_symbol", "symbol"))
    members = asks.join(rows.select("index_symbol", "symbol").distinct(), "index_symbol").select("as_of", F.struct("index_symbol", "symbol").alias("pair"))
    held = interval_join(members, rows.withColumn("confidence", F.when(F.col("announced_at").isNull(), "medium").otherwise("high")), "pair", "as_of", ("confidence",)).where("valid_from is not null")
    weighed = as_of_join(held, weights.withColumn("pair", F.struct("index_symbol", "symbol")), "pair", "as_of", "trade_date", ("weight",))
    flat = weighed.select("pair.index_symbol", "as_of", "pair.symbol", "weight", "valid_from", "confidence")
    called = interval_join(flat.select("symbol", "as_of"), names, values=("name",)).drop("valid_from").distinct()
    return flat.join(called, ["symbol", "as_of"], "left").select("index_symbol", "as_of", "symbol", "name", "weight", "valid_from", "confidence")


def materialised(pool: DataFrame, pool_key: str, as_of: str) -> DataFrame:
    """A universe as rows of the pool table: pool_key, as_of, symbol, eligible, exclusion_reason, name_at, status_at."""
    return pool.select(F.lit(pool_key).alias("pool_key"), F.lit(as_of).cast("date").alias("as_of"), "symbol", "eligible", "exclusion_reason", F.col("name").alias("name_at"), "status_at")


def replace_pool(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """The pool table after a new build: the (pool_key, as_of) that it holds are replaced whole."""
    built = fresh.select("pool_key", "as_of").distinct()
    return stored.join(built, ["pool_key", "as_of"], "left_anti").unionByName(fresh)


def pool_listing(stored: DataFrame, pool_key: str, as_of: str) -> DataFrame:
    """Members of a stored pool, by symbol."""
    return stored.where((F.col("pool_key") == pool_key) & (F.col("as_of") == F.lit(as_of).cast("date"))).orderBy("symbol")


def waterfall_report(pool: DataFrame) -> DataFrame:
    """One row: candidates, eligible ones, exclusions by reason, missing rows, and whether anything was degraded."""
    reasons = ("delisted", "suspended", "not_listed", "st", "no_bars")
    return pool.agg(
        F.count(F.lit(1)).alias("total_candidates"), F.count_if("eligible").alias("eligible_count"),
        F.count_if("selected").alias("selected_count"), *(F.count_if(F.col("exclusion_reason") == r).alias(f"excluded_{r}") for r in reasons),
        F.count_if("missing_status").alias("missing_status_rows"), F.count_if("missing_name").alias("missing_name_rows"), F.count_if("missing_st").alias("missing_st_rows"),
        F.bool_or("degraded").alias("pit_degraded"), F.max("expected_trading_days").alias("expected_trading_days"), F.max("least_trading_days").alias("least_trading_days"))


def waterfall_counts(pool: DataFrame) -> DataFrame:
    """Securities per reason; eligible ones count as 'eligible'."""
    return pool.groupBy(F.coalesce("exclusion_reason", F.lit("eligible")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def trade_gaps(grid: DataFrame, stocks: DataFrame, status: DataFrame) -> DataFrame:
    """symbol, trade_date, gap_type of each expected day without a bar.

    new_listing_gap before the listing, delisted_gap and suspended by what was
    known of the security's availability on that day, provider_gap where it
    was listed and should have traded, unknown where nothing is known. The
    present snapshot tells the listing date alone, which never changes.
    """
    gone = grid.where(F.col("close").isNull()).select("symbol", F.col("trade_date").alias("as_of"))
    at = timeline_as_of(gone, status_timeline(status)).join(stocks.select("symbol", "list_date"), "symbol", "left")
    kind = (
        F.when(F.col("list_date") > F.col("as_of"), "new_listing_gap").when(F.col("availability") == "delisted", "delisted_gap").when(F.col("availability") == "suspended", "suspended")
        .when(F.col("availability").isin("listed", "normal"), "provider_gap").otherwise("unknown"))
    return at.select("symbol", F.col("as_of").alias("trade_date"), kind.alias("gap_type"))


def coverage_report(status: DataFrame, names: DataFrame, st_status: DataFrame, constituents: DataFrame, weights: DataFrame, gaps: DataFrame) -> DataFrame:
    """One row: rows of the six tables, those of three without an announcement, provider gaps, and whether there is any history."""
    def one(df: DataFrame, **columns) -> DataFrame:
        return df.agg(*(c.alias(k) for k, c in columns.items()))

    rows, undated = F.count(F.lit(1)), F.count_if(F.col("announced_at").isNull())
    parts = [
        one(status, security_status_rows=rows, status_missing_announced_at=undated), one(names, security_name_rows=rows, name_missing_announced_at=undated),
        one(st_status, security_st_status_rows=rows, st_status_missing_announced_at=undated), one(constituents, index_constituent_rows=rows),
        one(weights, index_weight_snapshot_rows=rows), one(gaps, security_trade_gap_rows=rows, provider_gap_rows=F.count_if(F.col("gap_type") == "provider_gap"))]
    # six rows, one of each table
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.crossJoin(part)
    return whole.withColumn("pit_ready", (F.col("security_status_rows") > 0) | (F.col("security_name_rows") > 0))
