"""Queries over stored bars, securities, calendars and job logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RISK_PREFIX = r"^(ST|\*ST|SST|S\*ST)"
# Exchange by code prefix.
EXCHANGES = (("920", "BJ"), ("6", "SH"), ("9", "SH"), ("0", "SZ"), ("2", "SZ"), ("3", "SZ"), ("4", "BJ"), ("8", "BJ"))
MOST_SYMBOLS, LISTED_GAPS = 6000, 20


def clamp(n: int, most: int) -> int:
    """1..most."""
    return max(1, min(n, most))


def exchange_of(code: Column) -> Column:
    """Exchange of a security code, by its prefix; null for others."""
    out = F.lit(None).cast("string")
    for prefix, name in reversed(EXCHANGES):
        out = F.when(code.startswith(prefix), name).otherwise(out)
    return out


def normalize_symbol(x: Column) -> Column:
    """Six-digit code: exchange prefixes and suffixes dropped, digits padded; null where that is no code."""
    bare = F.regexp_replace(F.upper(F.trim(x)), r"^(SH|SZ|BJ)\.?|\.?(SH|SZ|BJ|SS)$", "")
    padded = F.when(bare.rlike(r"^[0-9]{1,6}$"), F.lpad(bare, 6, "0"))
    return F.when(padded.rlike(r"^[0-9]{6}$"), padded)


def normalize_score_symbol(x: Column) -> Column:
    """Codes that spreadsheets turned into numbers: a trailing .0 goes, digits are padded."""
    bare = F.regexp_replace(F.trim(x), r"\.0$", "")
    return F.when(bare.rlike(r"^[0-9]+$"), F.lpad(bare, 6, "0")).otherwise(bare)


def daily_bars(bars: DataFrame, symbols: list[str] | None, start: str, end: str) -> DataFrame:
    """Bars of some symbols in an inclusive range."""
    out = bars.where(F.col("trade_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return out if symbols is None else out.where(F.col("symbol").isin(symbols))


def eligible_stocks(stocks: DataFrame, exchanges: tuple[str, ...] = ("SH", "SZ"), drop_risk: bool = True) -> DataFrame:
    """Active securities of some exchanges, without risk names."""
    out = stocks.where((F.col("status") == "active") & F.col("exchange").isin(*exchanges))
    return out.where(~F.col("name").rlike(RISK_PREFIX) & ~F.col("name").contains("退")) if drop_risk else out


def search(stocks: DataFrame, keyword: str, limit: int = 20) -> DataFrame:
    """Securities whose code or name holds the keyword; exchange affixes of a full code are ignored."""
    import re

    bare = re.sub(r"^(SH|SZ|BJ)\.?(?=\d{6}$)|(?<=^\d{6})\.?(SH|SZ|BJ)$", "", keyword.strip().upper())
    hit = F.upper("symbol").contains(bare) | F.upper("name").contains(keyword.strip().upper())
    return stocks.where(hit).orderBy("symbol").limit(clamp(limit, 50))


#: Letters of a gram in the name index; shorter texts have postings of their own length.
GRAM = 3


def _grams(text: Column, size: Column) -> Column:
    """Distinct pieces of ``size`` letters."""
    last = F.length(text) - size + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, size)))).otherwise(F.array().cast("array<string>"))


def names_with(names: DataFrame, texts: DataFrame) -> DataFrame:
    """text, symbol of every name (symbol, name) that contains a text, by an inverted index of grams.

    A name is posted under each of its pieces of 1 to GRAM letters; a text is
    looked up under its rarest piece of GRAM letters (all of it, if shorter),
    and ``contains`` decides among the names found there. A text with a piece
    that no name has is met by none, and so is the empty text.
    """
    posted = names.where("name is not null").select("symbol", "name", F.explode(F.sequence(F.lit(1), F.lit(GRAM))).alias("size"))
    wanted = texts.select("text", F.least(F.length("text"), F.lit(GRAM)).alias("size")).where("size > 0").distinct()
    postings = posted.select("symbol", "name", F.explode(_grams(F.col("name"), F.col("size"))).alias("gram"))
    asked = wanted.select("text", F.explode(_grams(F.col("text"), F.col("size"))).alias("gram"))
    counts = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = asked.join(counts, "gram", "left").groupBy("text").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g")).where("g.n > 0")
    return rarest.select("text", "g.gram").join(postings, "gram").where(F.col("name").contains(F.col("text"))).select("text", "symbol")


def resolve(stocks: DataFrame, texts: DataFrame) -> DataFrame:
    """text -> symbol, rule: code, exact name, or the only name that contains the text; else null with the reason. Empty texts are unknown."""
    t = texts.select("text").distinct().withColumn("code", normalize_symbol(F.col("text")))
    names = stocks.select(F.col("symbol").alias("s"), "name")
    by_code = t.join(names, F.col("code") == F.col("s"), "left").groupBy("text").agg(F.max("s").alias("by_code"))
    by_name = t.join(names, F.col("text") == F.col("name"), "left").groupBy("text").agg(F.min("s").alias("by_name"))
    fuzzy = names_with(stocks.select("symbol", "name"), t).groupBy("text").agg(F.count("symbol").alias("n"), F.min("symbol").alias("like"))
    out = by_code.join(by_name, "text").join(fuzzy, "text", "left")
    rule = F.when(F.col("by_code").isNotNull(), "code").when(F.col("by_name").isNotNull(), "name").when(F.col("n") == 1, "contains").when(F.col("n") > 1, "ambiguous").otherwise("unknown")
    symbol = F.coalesce("by_code", "by_name", F.when(F.col("n") == 1, F.col("like")))
    return out.select("text", symbol.alias("symbol"), rule.alias("rule"))


def coverage(bars: DataFrame) -> DataFrame:
    """First and last date and number of bars per symbol."""
    return bars.groupBy("symbol").agg(F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"), F.count(F.lit(1)).alias("n_bars"))


def market_overview(bars: DataFrame) -> DataFrame:
    """Bars, symbols and range of the whole store."""
    return bars.agg(F.count(F.lit(1)).alias("n_bars"), F.countDistinct("symbol").alias("n_symbols"), F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"))


def covered_symbols(stocks: DataFrame, bars: DataFrame, start: str, end: str) -> DataFrame:
    """Eligible securities whose bars span a range."""
    spans = coverage(bars).where((F.col("first_date") <= F.lit(start).cast("date")) & (F.col("last_date") >= F.lit(end).cast("date")))
    return eligible_stocks(stocks).select("symbol", "name").join(spans, "symbol")


def sync_progress(stocks: DataFrame, bars: DataFrame, jobs: DataFrame, start: str, end: str, drop_risk: bool = True) -> DataFrame:
    """total, covered and percent: a security is covered by a finished job or by bars that span the range."""
    done = jobs.where(F.col("status").isin("success", "empty", "cached")).select("target").distinct()
    spans = coverage(bars).where((F.col("first_date") <= F.lit(start).cast("date")) & (F.col("last_date") >= F.lit(end).cast("date"))).select("symbol")
    base = eligible_stocks(stocks, drop_risk=drop_risk).select("symbol")
    marked = base.join(done.select(F.col("target").alias("symbol"), F.lit(True).alias("d")), "symbol", "left").join(spans.withColumn("s", F.lit(True)), "symbol", "left")
    out = marked.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce("d", "s", F.lit(False))).alias("covered"))
    percent = F.when(F.col("total") == 0, 100.0).otherwise(F.round(F.col("covered") * 100.0 / F.greatest("total", F.lit(1)), 2))
    return out.withColumn("percent", percent)


def next_symbols(stocks: DataFrame, jobs: DataFrame, limit: int = 10) -> DataFrame:
    """The next securities without a finished job."""
    done = jobs.where(F.col("status").isin("success", "empty", "cached")).select(F.col("target").alias("symbol"))
    return eligible_stocks(stocks).select("symbol").join(done, "symbol", "left_anti").orderBy("symbol").limit(clamp(limit, 50))


def consecutive_failures(jobs: DataFrame) -> DataFrame:
    """Length of each target's run of failures at the newest end of its log."""
    newest = Window.partitionBy("target").orderBy(F.desc("created_at"), F.desc("job_id"))
    ranked = jobs.withColumn("rn", F.row_number().over(newest))
    first_other = F.min(F.when(F.col("status") != "failed", F.col("rn")))
    return ranked.groupBy("target").agg(F.coalesce(first_other - 1, F.count(F.lit(1))).cast("long").alias("failures"))


def data_quality(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """expected, present and missing days of each symbol, and its first missing dates."""
    days = calendar.select("trade_date").distinct()
    n = days.agg(F.count(F.lit(1)).alias("expected"), F.sort_array(F.collect_set("trade_date")).alias("days"))
    have = bars.join(F.broadcast(days), "trade_date", "left_semi").groupBy("symbol").agg(F.collect_set("trade_date").alias("have"))
    out = have.join(F.broadcast(n)).withColumn("gone", F.array_except("days", "have"))
    return out.select("symbol", F.col("expected"), F.size("have").cast("long").alias("present"), F.size("gone").cast("long").alias("missing"), F.slice("gone", 1, LISTED_GAPS).alias("first_missing"))


def quality_totals(quality: DataFrame) -> DataFrame:
    """Symbols, fully covered ones, those with gaps, and missing bars in all."""
    return quality.agg(
        F.count(F.lit(1)).alias("n_symbols"), F.count_if(F.col("missing") == 0).alias("complete"), F.count_if(F.col("missing") > 0).alias("with_gaps"), F.sum("missing").alias("missing_bars"))


def select_research_symbols(stocks: DataFrame, bars: DataFrame, calendar: DataFrame, start: str, end: str, least: int | None = None, share: float = 0.8,
                            limit: int = 100, exchanges: tuple[str, ...] = ("SH", "SZ", "BJ"), drop_risk: bool = True) -> DataFrame:
    """Eligible securities with enough distinct dates in a range, most first.

    Enough are ``share`` of the calendar's days, 15 at most, or the caller's
    own ``least``, which only the calendar's days limit. Where the calendar is
    empty the days are 5/7 of the range's and ``least`` counts as it is.
    """
    import datetime as dt
    import math

    span = max(1, (dt.date.fromisoformat(end) - dt.date.fromisoformat(start)).days + 1)
    days = F.col("_days")
    if least is None:
        guess = max(1, min(15, math.ceil(max(1, round(span * 5 / 7)) * share)))
        need = F.when(days == 0, guess).otherwise(F.least(days, F.greatest(F.lit(1), F.least(F.lit(15), F.ceil(days * share)))))
    else:
        need = F.when(days == 0, max(1, least)).otherwise(F.greatest(F.lit(1), F.least(F.lit(least), days)))
    expected = calendar.where(F.col("trade_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).agg(F.countDistinct("trade_date").alias("_days"))
    n = daily_bars(bars, None, start, end).groupBy("symbol").agg(F.countDistinct("trade_date").alias("n_bars"))
    pool = eligible_stocks(stocks, exchanges, drop_risk=drop_risk).select("symbol").join(n, "symbol")
    # one row of expected days
    return pool.join(F.broadcast(expected)).where(F.col("n_bars") >= need).drop("_days").orderBy(F.desc("n_bars"), "symbol").limit(max(1, min(limit, MOST_SYMBOLS)))


def pool_diagnostics(stocks: DataFrame, bars: DataFrame, start: str, end: str) -> DataFrame:
    """Eligible securities with bars, their range, and the five with most bars."""
    n = daily_bars(bars, None, start, end).join(eligible_stocks(stocks).select("symbol"), "symbol", "left_semi")
    each = n.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_bars"), F.min("trade_date").alias("lo"), F.max("trade_date").alias("hi"))
    top = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n_bars")).alias("k"), "symbol"))), 1, 5)
    few = each.orderBy(F.desc("n_bars"), "symbol").limit(5).agg(F.array_join(F.transform(top, lambda x: x["symbol"]), ",").alias("top5"))
    return each.agg(F.count(F.lit(1)).alias("eligible"), F.min("lo").alias("first_date"), F.max("hi").alias("last_date"), F.sum("n_bars").alias("n_bars")).join(F.broadcast(few))


def amount_band(amount: Column) -> Column:
    """Five bands of an amount of money."""
    return (
        F.when(amount < 100_000, "under_100k_cny").when(amount < 500_000, "100k_to_500k_cny").when(amount < 1_000_000, "500k_to_1m_cny")
        .when(amount < 5_000_000, "1m_to_5m_cny").otherwise("over_5m_cny")
    )


def bar_violations(raw: DataFrame) -> DataFrame:
    """Rows that break a rule, with the first rule broken: missing value, price not positive, contradictory range. Zero volume is allowed."""
    prices = ("open", "high", "low", "close")
    missing = F.lit(False)
    for c in (*prices, "volume", "amount"):
        missing = missing | F.col(c).isNull() | F.isnan(c)
    bad_price = F.least(*(F.col(c) for c in prices)) <= 0
    contradiction = (F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high"))
    rule = F.when(missing, "missing_value").when(bad_price, "price_not_positive").when(contradiction | (F.col("volume") < 0), "contradiction")
    return raw.withColumn("rule", rule).where(F.col("rule").isNotNull())


# Columns that bars must have, in the order in which they are looked at.
REQUIRED = ("trade_date", "open", "high", "low", "close", "volume", "amount")
PRICES = ("open", "high", "low", "close")


def bar_errors(raw: DataFrame, label: str = "") -> DataFrame:
    """symbol, kind, column, row_indices, message: the error that the bars of each security raise; sound ones give no row.

    Kinds in their order: missing_column (of the whole table), nan_value,
    invalid_price, ohlc_contradiction; of a kind, the first column counts. Row
    indices are places in the security's bars by date, from 0; a contradiction
    names both its parts. Zero volume is allowed. The places are gathered per
    security, at most as many as it has bars.
    """
    absent = [c for c in REQUIRED if c not in raw.columns]
    if absent:
        text = f"{label}: missing columns: {', '.join(absent)}"
        return raw.select("symbol").distinct().select("symbol", F.lit("missing_column").alias("kind"), F.lit(",".join(absent)).alias("column"), F.array().cast("array<int>").alias("row_indices"), F.lit(text).alias("message"))
    order = Window.partitionBy("symbol").orderBy(F.asc_nulls_last("trade_date"))
    rows = raw.withColumn("_at", F.row_number().over(order) - 1)
    tests: list[tuple[str, str, Column]] = [("nan_value", c, F.col(c).isNull() | (F.isnan(c) if c != "trade_date" else F.lit(False))) for c in REQUIRED]
    tests += [("invalid_price", c, F.col(c) <= 0) for c in PRICES]
    tests += [("ohlc_contradiction", "high", F.col("high") < F.greatest("open", "close", "low")), ("ohlc_contradiction", "low", F.col("low") > F.least("open", "close", "high"))]
    places = [F.sort_array(F.collect_list(F.when(F.coalesce(test, F.lit(False)), F.col("_at")))).alias(f"_{k}") for k, (_, _, test) in enumerate(tests)]
    found = rows.groupBy("symbol").agg(*places)
    shown = lambda k: F.concat(F.lit("["), F.array_join(F.col(f"_{k}").cast("array<string>"), ", "), F.lit("]"))
    high, low = len(tests) - 2, len(tests) - 1
    parts = F.array_compact(F.array(
        F.when(F.size(f"_{high}") > 0, F.concat(F.lit("high < max(open, close, low) at row indices "), shown(high))), F.when(F.size(f"_{low}") > 0, F.concat(F.lit("low > min(open, close, high) at row indices "), shown(low)))))
    error = None
    for k, (kind, column, _) in enumerate(tests[:high]):
        what = F.struct(F.lit(kind).alias("kind"), F.lit(column).alias("column"), F.col(f"_{k}").alias("row_indices"), F.concat(F.lit(f"{label}: {kind} in {column} at row indices "), shown(k)).alias("message"))
        error = F.when(F.size(f"_{k}") > 0, what) if error is None else error.when(F.size(f"_{k}") > 0, what)
    both = F.struct(F.lit("ohlc_contradiction").alias("kind"), F.lit("high,low").alias("column"), F.array_distinct(F.concat(f"_{high}", f"_{low}")).alias("row_indices"), F.concat(F.lit(f"{label}: "), F.array_join(parts, "; ")).alias("message"))
    return found.withColumn("e", error.when(F.size(parts) > 0, both)).where("e is not null").select("symbol", "e.*")
