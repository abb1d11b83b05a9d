"""The timeline of a security: availability, risk tier and name as disjoint intervals of what was known."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The words of the mixed status table, by axis.
AVAILABILITY = ("listed", "normal", "suspended", "delisted")
RISK_TIERS = ("st", "sst", "st_star")

#: Axes of the sweep. The mixed table feeds two of them; its risk tiers are the fallback of the risk axis.
_AXES = ("availability", "legacy", "risk", "name")
TIMELINE = (
    "symbol string, valid_from date, valid_to date, status string, status_from date, availability string, st_status string, name string,"
    " status_degraded boolean, st_degraded boolean, name_degraded boolean")
_EPOCH = pd.Timestamp("1970-01-01")
_FAR = 2**31 - 1


class _Axis:
    """The rows of one axis that are open, the latest start first; a row is let go when it is met on top after its end."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def top(self, now: int) -> tuple | None:
        while self.rows and self.rows[0][2] <= now:
            heapq.heappop(self.rows)
        return self.rows[0] if self.rows else None


class _Sweep:
    """One security's rows in order of their knowledge; gives an interval whenever what is known changes."""

    def __init__(self, symbol: str):
        self.symbol, self.now, self.axes = symbol, None, {a: _Axis() for a in _AXES}
        self.held: tuple | None = None

    def known(self) -> tuple[tuple, int]:
        """What is known now, and until when at least."""
        a, legacy, risk, name = (self.axes[x].top(self.now) for x in _AXES)
        # rows are (-start, word reversed for ties, end, word, undated)
        mixed = min((r for r in (a, legacy) if r), default=None, key=lambda r: r[:2])
        risk_row = risk or legacy
        value = (
            mixed and mixed[3], mixed and -mixed[0], a and a[3], risk_row and risk_row[3], name and name[3],
            bool(mixed and mixed[4]), bool(risk_row and risk_row[4]), bool(name and name[4]))
        return value, min([r[2] for r in (a, legacy, risk, name) if r], default=_FAR)

    def advance(self, to: int) -> Iterator[tuple]:
        """Go on to a day, with every change on the way."""
        while self.now is not None and self.now < to:
            value, until = self.known()
            until = min(until, to)
            yield from self.state(value, self.now, until)
            self.now = until
        self.now = to

    def state(self, value: tuple, since: int, until: int) -> Iterator[tuple]:
        """Join an interval to the one before where nothing changed."""
        if self.held and self.held[0] == value and self.held[2] == since:
            self.held = (value, self.held[1], until)
            return
        yield from self.flush()
        self.held = (value, since, until)

    def flush(self) -> Iterator[tuple]:
        if self.held and any(v is not None for v in self.held[0][:5]):
            value, since, until = self.held
            yield (self.symbol, since, until, *value)
        self.held = None

    def end(self) -> Iterator[tuple]:
        yield from self.advance(_FAR)
        yield from self.flush()


class _Reversed(str):
    """A word whose order is turned round, so that the larger word wins a tie in a heap of least first."""

    __slots__ = ()

    def __lt__(self, other: str) -> bool:
        return str.__gt__(self, other)


def _swept(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by symbol and day of knowledge to intervals; only the open rows of one security are held."""
    sweep: _Sweep | None = None

    def frame(rows: list[tuple]) -> pd.DataFrame:
        columns = ["symbol", "valid_from", "valid_to", "status", "status_from", "availability", "st_status", "name", "status_degraded", "st_degraded", "name_degraded"]
        out = pd.DataFrame(rows, columns=columns, dtype=object)
        for c in ("valid_from", "valid_to", "status_from"):
            out[c] = [None if d is None or d == _FAR else (_EPOCH + pd.Timedelta(days=d)).date() for d in out[c]]
        return out

    for rows in frames:
        made: list[tuple] = []
        for symbol, axis, word, start, since, until, undated in rows.itertuples(index=False):
            if sweep is None or sweep.symbol != symbol:
                if sweep:
                    made += sweep.end()
                sweep = _Sweep(symbol)
            made += sweep.advance(since)
            heapq.heappush(sweep.axes[axis].rows, (-start, _Reversed(word), until, word, undated))
        if made:
            yield frame(made)
    if sweep:
        yield frame(list(sweep.end()))


def as_of_join(asks: DataFrame, rows: DataFrame, key: str, ask_time: str, row_time: str, values: tuple[str, ...]) -> DataFrame:
    """The values of each ask's latest row at or before its time.

    Both sides are laid in one order by key and time and the last row is
    carried forward: one exchange, no comparison of every ask with every row.
    """
    left = asks.select("*", F.col(ask_time).alias("_t"), F.lit(1).alias("_ask"), *(F.lit(None).cast(dict(rows.dtypes)[v]).alias(f"_{v}") for v in values), F.lit(None).cast(dict(rows.dtypes)[row_time]).alias("_at"))
    right = rows.select(*(F.col(key).alias(c) if c == key else F.lit(None).cast(t).alias(c) for c, t in asks.dtypes), F.col(row_time).alias("_t"), F.lit(0).alias("_ask"), *(F.col(v).alias(f"_{v}") for v in values), F.col(row_time).alias("_at"))
    w = Window.partitionBy(key).orderBy("_t", "_ask").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("_row", F.last(F.when(F.col("_ask") == 0, F.struct("_at", *(f"_{v}" for v in values))), ignorenulls=True).over(w))
    return both.where("_ask = 1").select(*asks.columns, F.col("_row._at").alias("row_time"), *(F.col(f"_row._{v}").alias(v) for v in values))


def status_timeline(status: DataFrame, risk: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """Disjoint intervals of each security in which nothing that is known about it changes.

    ``status`` is the mixed table (symbol, status, valid_from, valid_to,
    announced_at), ``risk`` the risk axis (st_status instead of status),
    ``names`` the names. At every day each axis has the row with the latest
    valid_from among those that are valid and announced (without an
    announcement: from their start on, marked degraded); of equal starts the
    larger word. A row that is announced late opens at its announcement and
    never hides an earlier one before. ``status`` is the mixed table's row,
    ``availability`` that among listed, normal, suspended and delisted,
    ``st_status`` the risk axis's row or, where it has none, the mixed table's
    risk tier. An open end is null. Rows that end before they are known, and
    rows without a symbol, word or start, do not count. A security's gaps have
    no interval.

    One exchange and one sort by security; a security's rows pass through the
    sweep in order and only those still open are held, so a long history costs
    no memory.
    """
    def rows(table: DataFrame, axis, word: str) -> DataFrame:
        day = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
        known = F.greatest(F.coalesce("announced_at", "valid_from"), "valid_from")
        return table.where(F.col("symbol").isNotNull() & F.col(word).isNotNull() & F.col("valid_from").isNotNull()).select(
            "symbol", axis.alias("axis"), F.col(word).alias("word"), day(F.col("valid_from")).alias("start"), day(known).alias("since"),
            F.coalesce(day(F.col("valid_to")), F.lit(_FAR)).alias("until"), F.col("announced_at").isNull().alias("undated")).where("since < until")

    tiers = F.when(F.col("status").isin(*RISK_TIERS), "legacy").when(F.col("status").isin(*AVAILABILITY), "availability")
    every = rows(status, tiers, "status").where("axis is not null")
    if risk is not None:
        every = every.unionByName(rows(risk, F.lit("risk"), "st_status"))
    if names is not None:
        every = every.unionByName(rows(names, F.lit("name"), "name"))
    return every.repartition("symbol").sortWithinPartitions("symbol", "since").mapInPandas(_swept, TIMELINE)


def timeline_as_of(asks: DataFrame, timeline: DataFrame, as_of: str = "as_of") -> DataFrame:
    """Every ask (symbol, as_of) with what was known then; all null where nothing was. One as-of join, as intervals are disjoint."""
    values = tuple(c for c in timeline.columns if c not in ("symbol", "valid_from"))
    met = as_of_join(asks, timeline, "symbol", as_of, "valid_from", values)
    open_ = F.col("valid_to").isNull() | (F.col("valid_to") > F.col(as_of))
    kept = [c for c in values if c != "valid_to"]
    return met.select(*asks.columns, *(F.when(open_, F.col(c)).alias(c) for c in kept))
