"""Small rules over many rows: critique of advice, exits of syncs, weights over symbols and positions, selections with their fallbacks, ordered readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Findings of a critique in their order: (code, severity, message).
FINDINGS = (
    ("future_market_evidence", "blocker", "Market evidence is later than the advisory date."),
    ("future_factor_evidence", "blocker", "Factor evidence is later than the advisory date."),
    ("future_news_evidence", "blocker", "A news item was known after the advisory date."),
    ("severe_company_news", "warning", "Severe company-risk news is present in the observed window."),
    ("concentrated_target", "warning", "A single accepted target exceeds 30% weight."),
    ("missing_oos_validation", "warning", "No eligible rolling OOS validation is attached to this draft."),
    ("invalid_oos_validation", "blocker", "The attached rolling OOS validation no longer matches the draft provenance."),
    ("expired_draft", "blocker", "The draft has expired and must be regenerated."),
)
MOST_WEIGHT = 0.3
SNAPSHOT_WARNING = "Current-snapshot universe used; historical status and index membership were not applied."


def critique(advice: DataFrame, news: DataFrame, weights: DataFrame) -> DataFrame:
    """advice_id, findings (array of code, severity, message, citation), approved_for_human_review.

    ``advice``: advice_id, as_of_date, status, market_end, factor_end,
    severe_count, has_validation, validation_matches. ``news``: advice_id,
    known_at. ``weights``: advice_id, weight. The first news item that was
    known too late, by time, is cited. Approval needs that nothing blocks.
    """
    late = news.join(advice.select("advice_id", "as_of_date"), "advice_id").where(F.to_date("known_at") > F.col("as_of_date")).groupBy("advice_id").agg(F.min("known_at").alias("_late"))
    most = weights.groupBy("advice_id").agg(F.max("weight").alias("_most"))
    rows = advice.join(late, "advice_id", "left").join(most, "advice_id", "left")
    day = F.col("as_of_date")
    matched, present = F.coalesce("validation_matches", F.lit(False)), F.coalesce("has_validation", F.lit(False))
    cases: dict[str, tuple[Column, Column]] = {
        "future_market_evidence": (F.col("market_end") > day, F.col("market_end").cast("string")), "future_factor_evidence": (F.col("factor_end") > day, F.col("factor_end").cast("string")),
        "future_news_evidence": (F.col("_late").isNotNull(), F.col("_late").cast("string")), "severe_company_news": (F.col("severe_count") > 0, F.lit("persisted news evidence")),
        "concentrated_target": (F.col("_most") > MOST_WEIGHT, F.lit("risk-gated target weights")), "missing_oos_validation": (~present, F.lit("advisory evidence snapshot")),
        "invalid_oos_validation": (present & ~matched, F.lit("advisory evidence snapshot")), "expired_draft": (F.col("status") == "expired", day.cast("string"))}
    found = F.array_compact(F.array(*(
        F.when(cases[code][0], F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(message).alias("message"), cases[code][1].alias("citation"))) for code, severity, message in FINDINGS)))
    return rows.select("advice_id", found.alias("findings"), (~F.exists(found, lambda f: f["severity"] == "blocker")).alias("approved_for_human_review"))


def exit_reason(remaining: Column, completed: Column, blocked: Column, processed: Column) -> Column:
    """completed, blocked, idle or continue: what a batch of a full sync leads to."""
    return F.when((F.coalesce(remaining, F.lit(0)) == 0) | completed, "completed").when(blocked, "blocked").when(processed == 0, "idle").otherwise("continue")


def stop_watching(reason: Column, remaining: Column, return_code: Column) -> Column:
    """struct(stop, why): a watcher stops when all is done, or when a run that ended well gives another reason than to go on. A missing state never stops."""
    left = F.coalesce(remaining, F.lit(1))
    ended = (F.coalesce(reason, F.lit("")) == "completed") | (left == 0)
    halt = (return_code == 0) & reason.isNotNull() & (reason != "continue")
    return F.struct((ended | F.coalesce(halt, F.lit(False))).alias("stop"), F.when(ended, "completed").otherwise(F.coalesce(reason, F.lit("continue"))).alias("why"))


def normalised_weights(raw: DataFrame, symbols: DataFrame, positions: DataFrame) -> DataFrame:
    """run_id, symbol, weight over all symbols asked for or held, 0 where the strategy gave none; ``problem`` where a weight is no finite number."""
    every = symbols.select("run_id", "symbol").unionByName(positions.select("run_id", "symbol")).distinct()
    given = raw.select("run_id", "symbol", F.col("weight").cast("double").alias("weight"), F.lit(True).alias("_given"))
    joined = every.join(given, ["run_id", "symbol"], "left")
    weight = F.when(F.col("_given").isNull(), 0.0).otherwise(F.col("weight"))
    bad = weight.isNull() | F.isnan(weight) | (F.abs(weight) == float("inf"))
    return joined.select("run_id", "symbol", F.when(~bad, weight).alias("weight"), F.when(bad, "not_finite").alias("problem"))


def buffered(ranks: DataFrame, held: DataFrame, top_n: int, hold: float = 1.3, entry: float = 1.0, cap: float = 0.05, gross: float = 0.8) -> DataFrame:
    """decision_date, symbol, weight of a choice that looks at what is held: held names stay up to the hold rank, others come in up to the entry rank.

    ``ranks``: decision_date, symbol, rank; ``held``: decision_date, symbol.
    Held names go first, by rank, then entries by rank, up to ``top_n`` in
    all; both ranks reach to top_n at least. Weights are equal, at most
    ``cap``, together at most ``gross``.
    """
    stays, comes = max(top_n, int(top_n * hold)), max(top_n, int(top_n * entry))
    rows = ranks.join(held.select("decision_date", "symbol").distinct().withColumn("_held", F.lit(True)), ["decision_date", "symbol"], "left")
    own = F.coalesce("_held", F.lit(False)) & (F.col("rank") <= stays)
    able = rows.withColumn("_own", own).where(F.col("_own") | (F.col("rank") <= comes))
    order = Window.partitionBy("decision_date").orderBy(F.desc("_own"), "rank")
    chosen = able.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= top_n)
    n = F.count(F.lit(1)).over(Window.partitionBy("decision_date"))
    return chosen.select("decision_date", "symbol", F.least(F.lit(cap), F.lit(gross) / n).alias("weight"))


def first_that_has_rows(*choices: DataFrame) -> DataFrame:
    """The first of some selections that gives rows; the last one where none does."""
    for choice in choices[:-1]:
        if not choice.isEmpty():
            return choice
    return choices[-1]


def snapshot_universe(source: str, manual: DataFrame | None, market: DataFrame | None) -> DataFrame:
    """symbol, degraded, warning of a universe of today's snapshot: the symbols asked for, or the market's selection."""
    if source not in ("manual", "market"):
        raise ValueError("index universes require the point-in-time tables")
    chosen = (manual if source == "manual" else market).select("symbol").distinct()
    return chosen.select("symbol", F.lit(True).alias("degraded"), F.lit(SNAPSHOT_WARNING).alias("warning"))


def trading_dates(calendar: DataFrame, start: str, end: str) -> DataFrame:
    """Open days of a calendar (trade_date, is_open) in a range, each once, in order."""
    open_days = calendar.where("is_open") if "is_open" in calendar.columns else calendar
    return open_days.where(F.col("trade_date").between(start, end)).select("trade_date").distinct().orderBy("trade_date")


def upsert_calendar(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """The calendar after days were stated anew: fresh ones replace stored ones; of a day stated twice, open counts."""
    days = fresh.groupBy("trade_date").agg(F.bool_or("is_open").alias("is_open"))
    return stored.join(days.select("trade_date"), "trade_date", "left_anti").select("trade_date", "is_open").unionByName(days)


def latest(rows: DataFrame, of: dict, at: str, key: str, limit: int = 50) -> DataFrame:
    """Rows with some values, the newest first, ties by key from the last: runs, validations of a run, jobs of a target."""
    for column, value in of.items():
        rows = rows.where(F.col(column) == value)
    return rows.orderBy(F.desc(at), F.desc(key)).limit(max(1, int(limit)))
