"""The dense date-by-symbol grid and the labels on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.windows import by_symbol, ratio


def dense_grid(bars: DataFrame) -> DataFrame:
    """Every date of the bars for every symbol; missing bars are rows of nulls.

    The dates are one short row that is exploded for each symbol, so the grid
    is made where the symbols are and joins the bars on both keys.
    """
    dates = bars.agg(F.sort_array(F.collect_set("trade_date")).alias("dates"))
    cells = bars.select("symbol").distinct().join(F.broadcast(dates)).select("symbol", F.explode("dates").alias("trade_date"))
    return cells.join(bars, ["symbol", "trade_date"], "left")


def forward_returns(grid: DataFrame, horizons: tuple[int, ...] = (1, 5, 10, 20)) -> DataFrame:
    """fwd_{h}d: entry at the next row's close, exit h rows later."""
    entry = F.lead("close", 1).over(by_symbol())
    return grid.withColumns({f"fwd_{h}d": ratio(F.lead("close", h + 1).over(by_symbol()), entry) - 1 for h in horizons})
