"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str, rounds: int = 60) -> DataFrame:
    """a, b -> node, root for every node that has an edge; root is the least node that it reaches.

    Every round joins each node's neighbours to the least of them, first the
    larger ones, then the smaller ones, until the edges form stars. Joins are
    by node with one row per edge, so a node with very many edges is split by
    the engine like any skewed join side. Only counts come to the driver.
    """
    now = scratch.write(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    mark = _mark(now)
    for turn in range(1, rounds):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.write(large, f"{name}-{turn}l")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        after = scratch.write(small.where("u <> v").distinct(), f"{name}-{turn}")
        scratch.drop(f"{name}-{turn}l", f"{name}-{turn - 1}")
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    else:
        raise ValueError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free digest of an edge set."""
    row = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first()
    return tuple(row)
