"""Next-day, lot-aware execution: one sequential fold per run, runs side by side.

Cash, lots and fees of a run depend on all that went before, so a run is one
group; a study has many runs (windows, cost cases, strategies), and those are
what Spark deals out. A run's group holds the prices of the securities that it
ever targets, as two arrays a date, not the whole market.
"""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.windows import ratio


@dataclass(frozen=True)
class Rules:
    """Costs, lots, price limits and exposure bounds of a run."""

    cash: float = 1_000_000.0
    commission: float = 0.0003
    least_commission: float = 5.0
    stamp_tax: float = 0.001
    slippage: float = 0.0005
    lot: int = 100
    limit: float = 0.10
    top_n: int = 10
    cap: float = 0.1
    gross: float = 0.95
    hold: float = 1.0
    entry: float = 1.0
    buffered: bool = False


OUT = "run_id string, kind string, trade_date date, symbol string, side string, price double, quantity long, amount double, fee double, tax double, equity double, cash double, position_value double"


class Account:
    """Cash and dated lots of one run."""

    def __init__(self, rules: Rules):
        self.rules, self.cash = rules, rules.cash
        self.lots: dict[str, list[list]] = {}
        self.marks: dict[str, float] = {}

    def held(self, symbol: str) -> int:
        """Shares of a security."""
        return sum(q for _, q in self.lots.get(symbol, ()))

    def value(self) -> float:
        """Positions at their last known price."""
        return sum(self.held(s) * self.marks.get(s, 0.0) for s in self.lots)

    def fee(self, amount: float) -> float:
        """Commission with its minimum; free where the rate is not positive."""
        r = self.rules
        return max(amount * r.commission, r.least_commission) if r.commission > 0 and amount > 0 else 0.0

    def whole(self, shares: float) -> int:
        """Shares in full lots."""
        return int(shares // self.rules.lot * self.rules.lot)

    def sell(self, symbol: str, shares: int, price: float, day: int) -> tuple[int, float, float, float]:
        """Sell what has been free since an earlier day, oldest lots first: shares, amount, fee, tax."""
        free = sum(q for d, q in self.lots[symbol] if d <= day)
        shares = self.whole(min(shares, free))
        if shares <= 0:
            return 0, 0.0, 0.0, 0.0
        left = shares
        for lot in self.lots[symbol]:
            if lot[0] <= day and left:
                part = min(lot[1], left)
                lot[1] -= part
                left -= part
        self.lots[symbol] = [lot for lot in self.lots[symbol] if lot[1]]
        if not self.lots[symbol]:
            del self.lots[symbol]
        amount = shares * price
        fee, tax = self.fee(amount), amount * self.rules.stamp_tax
        self.cash += amount - fee - tax
        return shares, amount, fee, tax

    def buy(self, symbol: str, shares: int, price: float, free_from: int) -> tuple[int, float, float, float]:
        """Buy as many full lots as the cash pays for, fees included."""
        r = self.rules
        if shares * price + self.fee(shares * price) > self.cash:
            shares = max(0, self.whole(self.cash / (price * (1 + r.commission))))
            while shares > 0 and shares * price + self.fee(shares * price) > self.cash:
                shares -= r.lot
        if shares <= 0:
            return 0, 0.0, 0.0, 0.0
        amount = shares * price
        fee = self.fee(amount)
        self.cash -= amount + fee
        self.lots.setdefault(symbol, []).append([free_from, shares])
        return shares, amount, fee, 0.0


def select_buffered(order: list[str], held: set[str], rules: Rules) -> list[str]:
    """Held names within the hold buffer in rank order, then new ones within the entry buffer."""
    stay = math.floor(max(rules.top_n, int(rules.top_n * rules.hold)))
    enter = max(rules.top_n, int(rules.top_n * rules.entry)) if rules.entry else len(order)
    kept = [s for s in order[:stay] if s in held][: rules.top_n]
    fresh = [s for s in order[:enter] if s not in kept]
    return kept + fresh[: rules.top_n - len(kept)]


def fold(days: list[tuple], rules: Rules, run_id: str) -> list[tuple]:
    """days: (date, {symbol: (close, volume)}, decision or None) in order; a decision is {symbol: weight}, or a ranking if buffered."""
    account, before, wanted, out = Account(rules), {}, None, []
    up, down = (1 + rules.limit) * 0.999, (1 - rules.limit) * 1.001
    for k, (date, market, decision) in enumerate(days):
        prices = {s: p for s, (p, _) in market.items() if p and p > 0}
        account.marks.update(prices)
        if wanted is not None:
            equity = account.cash + account.value()
            open_today = sorted(s for s in {*wanted, *account.lots} if s in prices and (market[s][1] or 0) > 0)
            gap = {s: equity * min(max(wanted.get(s, 0.0), 0.0), 1.0) - account.held(s) * prices[s] for s in open_today}
            for side in ("sell", "buy"):
                for s in open_today:
                    if (gap[s] > 0) != (side == "buy"):
                        continue
                    last, price = before.get(s), prices[s]
                    if last and ((side == "buy" and price >= last * up) or (side == "sell" and price <= last * down)):
                        continue
                    paid = price * (1 + rules.slippage if side == "buy" else 1 - rules.slippage)
                    shares = account.whole(abs(gap[s]) / paid)
                    if shares <= 0 or (side == "sell" and s not in account.lots):
                        continue
                    shares, amount, fee, tax = account.buy(s, shares, paid, k + 1) if side == "buy" else account.sell(s, shares, paid, k)
                    if shares:
                        out.append((run_id, "trade", date, s, side, round(paid, 4), shares, round(amount, 2), round(fee, 2), round(tax, 2), None, None, None))
            wanted = None
        if decision is not None:
            if rules.buffered:
                picked = select_buffered(decision, set(account.lots), rules)
                wanted = {s: min(rules.cap, rules.gross / len(picked)) for s in picked} if picked else {}
            else:
                wanted = decision
        value = account.value()
        out.append((run_id, "equity", date, None, None, None, None, None, None, None, round(account.cash + value, 2), round(account.cash, 2), round(value, 2)))
        before.update(prices)
    return out


def simulate(bars: DataFrame, decisions: DataFrame, runs: dict[str, Rules]) -> DataFrame:
    """Fold every run: ``decisions`` has decision_date, symbol, and weight (or rank for buffered runs).

    Decisions and prices meet by date in Spark first; what reaches a run's task
    is one row per date with the prices of targeted securities.
    """
    spark = bars.sparkSession
    ever = decisions.select("symbol").distinct()
    axis = bars.select("trade_date").distinct()
    prices = bars.join(ever, "symbol", "left_semi").groupBy("trade_date").agg(F.collect_list(F.struct("symbol", "close", "volume")).alias("market"))
    value = "rank" if "rank" in decisions.columns else "weight"
    asks = decisions.groupBy(F.col("decision_date").alias("trade_date")).agg(F.sort_array(F.collect_list(F.struct(F.col(value).cast("double").alias("v"), "symbol"))).alias("decision"))
    days = axis.join(prices, "trade_date", "left").join(asks, "trade_date", "left")
    cases = spark.createDataFrame([(k,) for k in runs], "run_id string")
    params = {k: asdict(v) for k, v in runs.items()}

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rules = Rules(**params[key[0]])
        rows = []
        for r in pdf.sort_values("trade_date").itertuples(index=False):
            market = {m["symbol"]: (m["close"], m["volume"]) for m in r.market} if r.market is not None else {}
            picks = [(d["symbol"], d["v"]) for d in r.decision] if r.decision is not None else None
            rows.append((r.trade_date, market, None if picks is None else [s for s, _ in picks] if rules.buffered else dict(picks)))
        return pd.DataFrame(fold(rows, rules, key[0]), columns=[c.split()[0] for c in OUT.split(", ")])

    return days.join(F.broadcast(cases)).groupBy("run_id").applyInPandas(run, OUT)


def equity_curve(events: DataFrame) -> DataFrame:
    """run_id, trade_date, equity, cash, position_value, drawdown from the running peak."""
    w = Window.partitionBy("run_id").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    return events.where("kind = 'equity'").select("run_id", "trade_date", "equity", "cash", "position_value", F.round(ratio(F.col("equity"), F.max("equity").over(w)) - 1, 6).alias("drawdown"))


def trades(events: DataFrame) -> DataFrame:
    """The trades of all runs."""
    return events.where("kind = 'trade'").select("run_id", "trade_date", "symbol", "side", "price", "quantity", "amount", F.col("fee").alias("commission"), F.col("tax").alias("stamp_tax"))


def metrics(curve: DataFrame, initial: float, benchmark: DataFrame | None = None, per_year: int = 252) -> DataFrame:
    """Per run: total and annual return, drawdown, Sharpe ratio, final equity, and the benchmark's return over the same dates."""
    w = Window.partitionBy("run_id").orderBy("trade_date")
    rows = curve.withColumn("_r", ratio(F.col("equity"), F.lag("equity").over(w)) - 1)
    out = rows.groupBy("run_id").agg(
        F.max_by("equity", "trade_date").alias("final_equity"), F.count(F.lit(1)).alias("_n"), F.min("drawdown").alias("max_drawdown"),
        F.avg("_r").alias("_m"), F.stddev_samp("_r").alias("_s"), F.min("trade_date").alias("_from"), F.max("trade_date").alias("_to"))
    total = F.col("final_equity") / initial - 1
    sharpe = F.when(F.col("_s") > 0, F.col("_m") / F.col("_s") * math.sqrt(per_year)).otherwise(0.0)
    out = out.withColumns({"total_return": F.round(total, 6), "annual_return": F.round(F.pow(1 + total, per_year / F.col("_n")) - 1, 6), "sharpe": F.round(sharpe, 6)})
    if benchmark is None:
        out = out.withColumn("benchmark_return", F.lit(0.0))
    else:
        dates = curve.select("trade_date").distinct()
        b = benchmark.join(dates, "trade_date", "left_semi").agg((F.max_by("close", "trade_date") / F.min_by("close", "trade_date") - 1).alias("_b"))
        out = out.join(F.broadcast(b)).withColumn("benchmark_return", F.round(F.coalesce("_b", F.lit(0.0)), 6)).drop("_b")
    return out.withColumn("excess_return", F.round(F.col("total_return") - F.col("benchmark_return"), 6)).drop("_n", "_m", "_s", "_from", "_to")


def trade_stats(trade_rows: DataFrame, initial: float) -> DataFrame:
    """Per run: counts and amounts by side, turnover and costs."""
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("amount")).otherwise(0.0))
    return trade_rows.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_trades"), side("buy").alias("buy_amount"), side("sell").alias("sell_amount"),
        (F.sum("amount") / initial).alias("turnover"), F.sum(F.col("commission") + F.col("stamp_tax")).alias("costs"))


def monthly_report(curve: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per month: return from its first to its last value, the benchmark's (carried forward over gaps, null without any value yet), excess and worst drawdown."""
    w = Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    both = curve.join(benchmark.select("trade_date", F.col("close").alias("b")), "trade_date", "left").withColumn("b", F.last("b", ignorenulls=True).over(w))
    when = lambda c: F.when(F.col(c).isNotNull(), F.col("trade_date"))
    ends = [f(c, when(c)).alias(f"_{c}{k}") for c in ("equity", "b") for k, f in enumerate((F.min_by, F.max_by))]
    month = both.groupBy(F.date_format("trade_date", "yyyy-MM").alias("month")).agg(*ends, F.min("drawdown").alias("max_drawdown"))
    gain = lambda c: F.when(F.col(f"_{c}0") > 0, F.col(f"_{c}1") / F.col(f"_{c}0") - 1).otherwise(0.0)
    out = month.withColumns({"return": gain("equity"), "benchmark_return": F.when(F.col("_b0").isNotNull(), gain("b"))})
    return out.select("month", "return", "benchmark_return", (F.col("return") - F.col("benchmark_return")).alias("excess_return"), "max_drawdown")


def monthly_summary(months: DataFrame) -> DataFrame:
    """One row: months, those with positive and negative excess, and the mean, worst and best excess."""
    e = F.col("excess_return")
    return months.agg(
        F.count(F.lit(1)).alias("months"), F.count_if(e > 0).alias("positive_excess_months"), F.count_if(e < 0).alias("negative_excess_months"),
        F.avg(e).alias("mean_monthly_excess"), F.min(e).alias("worst_monthly_excess"), F.max(e).alias("best_monthly_excess"))


def walk_forward_windows(dates: DataFrame, train: int, test: int, warmup: int = 0) -> DataFrame:
    """Non-overlapping test windows after a training span; an incomplete tail is dropped. Index arithmetic over the date axis."""
    axis = dates.select("trade_date").distinct().withColumn("idx", F.row_number().over(Window.orderBy("trade_date")) - 1)
    ends = axis.agg(F.count(F.lit(1)).alias("n"))
    starts = ends.where(F.col("n") >= train + test).select(F.posexplode(F.sequence(F.lit(train), F.col("n") - test, F.lit(test))).alias("window_id", "s"))
    pick = lambda name: axis.select(F.col("trade_date").alias(name), F.col("idx").alias(f"_{name}"))
    out = starts
    for name, at in (("train_start", F.greatest(F.col("s") - train, F.lit(0))), ("warmup_start", F.greatest(F.col("s") - warmup, F.lit(0))), ("test_start", F.col("s")), ("test_end", F.col("s") + test - 1)):
        out = out.join(F.broadcast(pick(name)), at == F.col(f"_{name}")).drop(f"_{name}")
    return out.select("window_id", "train_start", "warmup_start", "test_start", "test_end")
