"""Window building blocks: guarded rolling aggregates, correlations, ranks and buckets."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def by_symbol() -> WindowSpec:
    """Every trailing window shares this partitioning and order, so all of them run in one exchange and one sort."""
    return Window.partitionBy("symbol").orderBy("trade_date")


def trailing(n: int) -> WindowSpec:
    """The last n rows, the current one included."""
    return by_symbol().rowsBetween(-(n - 1), 0)


class Shared:
    """What factors share: windows of Spark by name, and moving aggregates, computed from their inputs after those."""

    def __init__(self):
        self.windows: dict[str, tuple[str, Column]] = {}
        self.inputs: dict[str, tuple[str, Column]] = {}
        self.moves: dict[tuple[str, int, tuple[str, ...]], str] = {}

    def window(self, key: str, window: Column) -> Column:
        return F.col(self.windows.setdefault(key, (f"_w{len(self.windows)}", window))[0])

    def moving(self, kind: str, n: int, xs: tuple[Column, ...]) -> Column:
        own = tuple(self.inputs.setdefault(str(x), (f"_x{len(self.inputs)}", x))[0] for x in xs)
        return F.col(self.moves.setdefault((kind, n, own), f"_m{len(self.moves)}"))


_shared: Shared | None = None


@contextmanager
def sharing() -> Iterator[Shared]:
    """Within it windows and moving aggregates are named once; what is collected is to be added as columns before the expressions are used."""
    global _shared
    before, _shared = _shared, Shared()
    try:
        yield _shared
    finally:
        _shared = before


def over(aggregate: Column, n: int) -> Column:
    """An aggregate over the last n rows: a reference to its shared column, or the window itself."""
    window = aggregate.over(trailing(n))
    return window if _shared is None else _shared.window(f"{aggregate}|{n}", window)


def moving(kind: str, n: int, *xs: Column) -> Column:
    """A moving aggregate by its name in ``functions/moving.py``, null unless the last n rows are there and none is null; only for what ``compute`` builds."""
    if _shared is None:
        raise ValueError("moving aggregates are made by compute alone")
    return _shared.moving(kind, n, xs)


_MOVING = {F.sum: "sum", F.avg: "avg", F.min: "min", F.max: "max", F.stddev_samp: "std"}


def rolling(agg: Callable[[Column], Column], x: Column, n: int) -> Column:
    """An aggregate over the last n rows that is null unless all n values are present."""
    if _shared is not None and agg in _MOVING:
        return moving(_MOVING[agg], n, x)
    return F.when(over(F.count(x), n) == n, over(agg(x), n))


def lag(x: Column, n: int = 1) -> Column:
    """The value n rows before."""
    window = F.lag(x, n).over(by_symbol())
    return window if _shared is None else _shared.window(f"lag {x}|{n}", window)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a, b)


def rolling_corr(x: Column, y: Column, n: int) -> Column:
    """Pearson correlation of n complete pairs; null where a side is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return ratio(moving("covar", n, a, b), moving("std", n, a) * moving("std", n, b))


def rolling_skew(x: Column, n: int) -> Column:
    """Bias-corrected skewness; 0 where the window is constant."""
    return F.when(moving("std", n, x) == 0, F.lit(0.0)).otherwise(moving("skew", n, x) * ((n * (n - 1)) ** 0.5) / (n - 2))


def average_rank(order: str, *keys: str) -> Column:
    """Rank from 1 with ties averaged, within keys."""
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, order))
    return F.rank().over(Window.partitionBy(*keys).orderBy(order)) + (ties - 1) / 2.0


def bucket(order: str, groups: int, key: str = "trade_date", tie: str = "symbol") -> Column:
    """Quantile bucket 1..groups: ceil(first-come rank / n * groups). Not NTILE."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order, tie))
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    return F.greatest(F.lit(1), F.least(F.lit(groups), F.ceil(rank * groups / n))).cast("int")
