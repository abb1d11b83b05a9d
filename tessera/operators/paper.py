"""The paper portfolio: promotion checks over all advice, snapshots and validations that are committed whole or not at all."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.repository import normalize_symbol
from tessera.sources.manifest import Conflict, GuardedTables
from tessera.sources.sinks import append_once

#: Distinct test windows that a promotion asks for, shares of a lot, and money that counts as equal.
LEAST_WINDOWS, LOT, CENT = 3, 100, 0.01

# The reasons against a promotion, in their order.
REASONS = {
    "review": "Advisory must be explicitly reviewed before paper promotion.",
    "expired": "Advisory has expired because newer local bars are available after its execution window.",
    "no_evidence": "Advisory has no attached rolling OOS validation evidence.",
    "bad_id": "Advisory validation evidence has an invalid validation ID.",
    "gone": "Attached rolling OOS validation no longer exists.",
    "not_eligible": "Attached rolling OOS validation is not completed and eligible.",
    "no_source": "Attached rolling OOS validation has incomplete source provenance.",
    "bad_windows": "Attached rolling OOS validation has invalid window metadata.",
    "few_windows": "At least three distinct rolling OOS windows are required for paper promotion.",
    "late_window": "The latest rolling OOS window must end on the advisory as-of date.",
    "mismatch": "Rolling OOS validation provenance does not match this advisory.",
}


class Refused(ValueError):
    """A snapshot or promotion that must not be stored; the portfolio is as it was."""


def window_state(windows: DataFrame) -> DataFrame:
    """validation_id, n_ends, last_end, valid: whether a validation's windows (oos_start, oos_end, has_result) are ordered, apart and with results."""
    from pyspark.sql import Window

    w = Window.partitionBy("validation_id").orderBy("oos_start", "oos_end")
    before = F.lag("oos_end").over(w)
    bad = F.col("oos_start").isNull() | F.col("oos_end").isNull() | (F.col("oos_start") > F.col("oos_end")) | F.coalesce(before >= F.col("oos_start"), F.lit(False)) | ~F.coalesce("has_result", F.lit(False))
    return windows.withColumn("_bad", bad).groupBy("validation_id").agg(F.countDistinct("oos_end").alias("n_ends"), F.max("oos_end").alias("last_end"), (F.count_if("_bad") == 0).alias("valid"))


def promotion_eligibility(advice: DataFrame, expired: DataFrame, validations: DataFrame, runs: DataFrame, provenance: DataFrame, windows: DataFrame) -> DataFrame:
    """advice_id, eligible, validation_id, oos_window_count, reasons of every advice.

    ``advice``: advice_id, strategy_name, as_of_date, status, reviewed_at,
    has_evidence, validation_id and the run_id, fingerprint and as_of that its
    evidence names (ev_*). ``expired``: advice_id, expired. A reason that ends
    the examination hides the later ones: no evidence, an id that is none, a
    validation that is gone, a source that is incomplete, invalid windows.
    A validation without windows has none that is invalid.
    """
    v = validations.select(
        "validation_id", F.col("run_id").alias("v_run"), F.col("status").alias("v_status"), "eligibility_status", "source_fingerprint", "spec_strategy", "spec_run_id", "spec_fingerprint", F.col("fingerprint").alias("v_print"))
    r = runs.select(F.col("run_id").alias("v_run"), F.col("strategy_name").alias("r_strategy"))
    p = provenance.select(F.col("run_id").alias("v_run"), F.col("fingerprint").alias("p_print"))
    rows = advice.join(expired, "advice_id", "left").join(v.withColumn("_v", F.lit(True)), "validation_id", "left").join(r.withColumn("_r", F.lit(True)), "v_run", "left")
    rows = rows.join(p.withColumn("_p", F.lit(True)), "v_run", "left").join(window_state(windows), "validation_id", "left")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    evidence, has_id = F.coalesce("has_evidence", F.lit(False)), F.coalesce(F.col("validation_id") >= 1, F.lit(False))
    there = evidence & has_id & F.col("_v").isNotNull()
    sourced = there & F.col("_r").isNotNull() & F.col("_p").isNotNull()
    windowed = sourced & F.coalesce("valid", F.lit(True))
    n = F.coalesce("n_ends", F.lit(0))
    same = (
        (F.col("r_strategy") == F.col("strategy_name")) & (F.col("spec_strategy") == F.col("strategy_name")) & (F.col("spec_run_id") == F.col("v_run")) & (F.col("spec_fingerprint") == F.col("p_print"))
        & (F.col("source_fingerprint") == F.col("p_print")) & (F.col("ev_run_id") == F.col("v_run")) & (F.col("ev_fingerprint") == F.col("v_print")) & (F.col("ev_as_of") == F.col("as_of_date")))
    tests: dict[str, Column] = {
        "review": no((F.col("status") == "reviewed") & F.col("reviewed_at").isNotNull()), "expired": F.coalesce("expired", F.lit(False)), "no_evidence": ~evidence, "bad_id": evidence & ~has_id,
        "gone": evidence & has_id & F.col("_v").isNull(), "not_eligible": there & no((F.col("v_status") == "completed") & (F.col("eligibility_status") == "eligible")), "no_source": there & ~sourced,
        "bad_windows": sourced & ~windowed, "few_windows": windowed & (n < LEAST_WINDOWS), "late_window": windowed & (F.coalesce("last_end", "as_of_date") != F.col("as_of_date")), "mismatch": windowed & no(same)}
    reasons = F.array_compact(F.array(*(F.when(test, REASONS[name]) for name, test in tests.items())))
    return rows.select("advice_id", (F.size(reasons) == 0).alias("eligible"), F.when(evidence & has_id, F.col("validation_id")).alias("validation_id"), F.when(windowed, n).otherwise(0).alias("oos_window_count"), reasons.alias("reasons"))


def lots(weights: DataFrame, closes: DataFrame, equity: float) -> DataFrame:
    """symbol, quantity, price: whole lots that the weights of an equity buy at the closes; none of 0."""
    rows = weights.join(closes.where("price > 0"), "symbol")
    quantity = (F.floor(F.lit(float(equity)) * F.col("weight") / F.col("price") / LOT) * LOT).cast("long")
    return rows.select("symbol", quantity.alias("quantity"), "price").where("quantity > 0")


class PaperPortfolio:
    """One portfolio whose snapshots are commits: positions and valuation of a day appear together.

    A snapshot is made from the state that was read first; where another one
    was committed meanwhile, it is refused with Conflict and leaves nothing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.tables = spark, GuardedTables(spark, path)

    def state(self) -> tuple[int, str | None, float]:
        """Commit number, date and cash of the latest snapshot."""
        version, content = self.tables.state()
        return version, content["notes"].get("as_of"), content["notes"].get("cash", 0.0)

    def positions(self) -> DataFrame:
        """symbol, quantity, reference_price, price_date of the latest snapshot."""
        return self.tables.table("positions")

    def valuations(self) -> DataFrame:
        """as_of, cash, position_value, equity: the last one stored for each day."""
        rows = self.tables.table("valuations")
        return rows.groupBy("as_of").agg(F.max_by(F.struct("cash", "position_value", "equity"), "version").alias("v")).select("as_of", "v.*")

    @staticmethod
    def _names(rows: DataFrame, most: int = 20) -> str:
        return ", ".join(str(r[0]) for r in rows.orderBy(rows.columns[0]).limit(most).collect())

    def save(self, as_of: str, cash: float, positions: DataFrame, stocks: DataFrame, bars: DataFrame, seen: int | None = None) -> int:
        """Store a snapshot (symbol, quantity), valued at the closes of its day; gives the commit.

        Quantities of one security are added up. Unknown securities, a missing
        close and a day before the latest snapshot are refused. A snapshot of
        the latest day replaces it.
        """
        version, latest, _ = self.state()
        version = version if seen is None else seen
        if not math.isfinite(cash):
            raise Refused("cash must be a finite number")
        if latest and as_of < latest:
            raise Refused("A snapshot earlier than the current portfolio date cannot be applied.")
        held = positions.select(F.col("symbol").alias("asked"), F.coalesce(normalize_symbol(F.col("symbol")), F.col("symbol")).alias("symbol"), "quantity")
        unknown = held.join(stocks.select("symbol"), "symbol", "left_anti").select("asked")
        if not unknown.isEmpty():
            raise Refused(f"unknown securities: {self._names(unknown)}")
        sums = held.groupBy("symbol").agg(F.sum("quantity").cast("long").alias("quantity"))
        closes = bars.where((F.col("trade_date") == as_of) & (F.col("close") > 0)).select("symbol", F.col("close").alias("reference_price"))
        missing = sums.join(closes, "symbol", "left_anti").select("symbol")
        if not missing.isEmpty():
            raise Refused(f"No local close on the snapshot date for: {self._names(missing)}")
        valued = sums.join(closes, "symbol").withColumn("price_date", F.lit(as_of).cast("date"))
        total = valued.agg(F.coalesce(F.round(F.sum(F.col("quantity") * F.col("reference_price")), 2), F.lit(0.0)).alias("position_value"))
        valuation = total.select(
            F.lit(as_of).cast("date").alias("as_of"), F.round(F.lit(float(cash)), 2).alias("cash"), "position_value", F.round(F.round(F.lit(float(cash)), 2) + F.col("position_value"), 2).alias("equity"), F.lit(version + 1).cast("long").alias("version"))
        return self.tables.apply(version, {"valuations": valuation}, {"positions": valued}, {"as_of": as_of, "cash": float(cash)})

    def promote(self, as_of: str, equity: float, weights: DataFrame, stocks: DataFrame, bars: DataFrame, reasons: list[str] = (), capital: float = 1.0) -> int:
        """Take over an advice's accepted weights (symbol, weight) in whole lots; gives the commit.

        Refused with reasons against it, with weights above ``capital`` in all
        (1; more for an account that buys on margin, whose cash may then be
        negative), without a positive equity or a close of its day, or where
        the portfolio has another snapshot of that day. The same promotion
        again changes nothing.
        """
        if reasons:
            raise Refused("Advisory cannot be promoted: " + " ".join(reasons))
        row = weights.agg(F.coalesce(F.sum("weight"), F.lit(0.0)), F.count_if(F.col("weight").isNull() | F.isnan("weight") | (F.col("weight") < 0))).first()
        if row[1] or row[0] > capital + 1e-9:
            raise Refused("Advisory cannot be promoted: accepted target weights exceed total capital.")
        if not math.isfinite(equity) or equity <= 0:
            raise Refused("Advisory cannot be promoted: total equity is not a finite positive value.")
        closes = bars.where((F.col("trade_date") == as_of) & (F.col("close") > 0)).select("symbol", F.col("close").alias("price"))
        missing = weights.join(closes, "symbol", "left_anti").select("symbol")
        if not missing.isEmpty():
            raise Refused(f"Advisory cannot be promoted; local close is missing for: {self._names(missing)}")
        bought = lots(weights, closes, equity)
        spent = bought.agg(F.coalesce(F.sum(F.col("quantity") * F.col("price")), F.lit(0.0))).first()[0]
        cash = round(equity - spent, 2)
        version, latest, held_cash = self.state()
        if latest == as_of:
            old = self.positions().select("symbol", "quantity")
            new = bought.select("symbol", "quantity")
            if old.exceptAll(new).isEmpty() and new.exceptAll(old).isEmpty() and abs(held_cash - cash) <= CENT:
                return version
            raise Refused("Paper portfolio already has a different snapshot on this advisory date; promotion will not overwrite it.")
        return self.save(as_of, cash, bought.select("symbol", "quantity"), stocks, bars, seen=version)


def save_validations(tables: GuardedTables, validations: DataFrame, seen: int | None = None) -> int:
    """Store validations that aren't stored yet, and a cemetery row for each that is not eligible, in one commit.

    ``validations``: validation_id, run_id, strategy_name, eligibility_status,
    flags (array), fingerprint. Fingerprints tell which are stored: the same
    validations again give no commit. A writer that another overtook gets
    Conflict, and neither table has its rows.
    """
    version, content = tables.state()
    version = version if seen is None else seen
    fresh = validations if "validations" not in content["tables"] else append_once(tables.table("validations"), validations)
    fresh = fresh.dropDuplicates(["fingerprint"])
    if fresh.isEmpty():
        return version
    told = F.array_join(F.filter("flags", lambda f: f.isNotNull() & (f != "")), "; ")
    buried = fresh.where(F.col("eligibility_status") != "eligible").select(
        F.lit("strategy").alias("research_type"), F.coalesce("strategy_name", F.lit("unknown_strategy")).alias("subject_name"), F.col("validation_id").cast("string").alias("source_ref"),
        F.col("fingerprint").alias("source_fingerprint"), F.coalesce(F.nullif(told, F.lit("")), "eligibility_status").alias("reason"))
    return tables.apply(version, {"validations": fresh, "cemetery": buried})


__all__ = ["Conflict", "PaperPortfolio", "Refused", "lots", "promotion_eligibility", "save_validations", "window_state"]
