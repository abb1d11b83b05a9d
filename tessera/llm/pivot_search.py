"""Exact top-k inner products by pivot-table elimination."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Pivots (a bounded sample), queries in a block, candidates evaluated at a turn, candidates bounded at once.
PIVOTS, BLOCK, TURN, SLAB = 48, 1024, 64, 4096
#: Largest component for which sums of products are exact in doubles for any usual dimension.
EXACT = 2**53


def quantised(embedding: Column, factor: int = 256) -> Column:
    """floor(factor * x) of each component as a whole double, or null where the vector takes no part.

    Null vectors and those with null, NaN or infinite components take no part.
    A double of 2^52 or more is whole as it is, so no component is too large;
    only one whose product with ``factor`` is beyond all doubles has no value.
    """
    def whole(x: Column) -> Column:
        y = x.cast("double") * factor
        return F.when(F.abs(y) < 2.0**52, F.floor(F.when(F.abs(y) < 2.0**52, y)).cast("double")).otherwise(y)

    sound = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double") * factor) < F.lit(float("inf"))))
    return F.when(embedding.isNotNull() & sound, F.transform(embedding, whole))


def _matrix(rows) -> np.ndarray:
    rows = list(rows)
    return np.array(rows, np.float64).reshape(len(rows), len(rows[0]) if rows else 0)


_WHOLE = np.frompyfunc(int, 1, 1)


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise integer inner products of (n, d) queries and (n, m, d) candidates."""
    top = (int(np.abs(a).max(initial=0)) + 1) * (int(np.abs(b).max(initial=0)) + 1) * max(1, a.shape[-1])
    if top < EXACT:
        return np.einsum("nd,nmd->nm", a, b).astype(np.int64)
    exact = (_WHOLE(a)[:, None, :] * _WHOLE(b)).sum(-1)
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def pivot_distances(vectors: np.ndarray, lifted: np.ndarray, pivots: np.ndarray, pivot_lift: np.ndarray) -> np.ndarray:
    """Euclidean distances to the pivots of vectors with one more, lifted, coordinate."""
    square = (vectors**2).sum(1) + lifted**2
    other = (pivots**2).sum(1) + pivot_lift**2
    both = vectors @ pivots.T + lifted[:, None] * pivot_lift
    return np.sqrt(np.maximum(square[:, None] + other - 2 * both, 0))


class Block:
    """One block of queries against streams of candidates: bounds first, then scores in bound order."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.pivots = pivots.astype(np.float64)
        self.top = np.full((len(ids), k), np.iinfo(np.int64).min)
        self.who = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.any = np.zeros((len(ids), k), bool)
        self.evaluated = 0

    def feed(self, ids: np.ndarray, vectors: np.ndarray, table: np.ndarray, reach: float) -> None:
        """Candidates with their table of pivot distances; ``reach`` is the lifted norm of all candidates.

        A query has a lifted coordinate of 0 and a candidate one that brings
        its norm to ``reach``: then score = (|q|^2 + reach^2 - distance^2) / 2,
        and the largest |d(q, p) - d(x, p)| over the pivots bounds the distance
        from below, so the score from above.
        """
        q = self.vectors.astype(np.float64)
        own = pivot_distances(q, np.zeros(len(q)), self.pivots, np.sqrt(np.maximum(reach**2 - (self.pivots**2).sum(1), 0)))
        low = np.zeros((len(q), len(ids)))
        for p in range(table.shape[1]):
            np.maximum(low, np.abs(own[:, p, None] - table[None, :, p]), out=low)
        limit = ((q**2).sum(1)[:, None] + reach**2 - low**2) / 2
        limit += 1e-9 * (reach**2 + (q**2).sum(1)[:, None]) + 1e-6
        # squares beyond all doubles bound nothing
        limit[np.isnan(limit)] = np.inf
        order = np.argsort(-limit, axis=1)
        sorted_limit = np.take_along_axis(limit, order, 1)
        live = np.arange(len(q))
        for start in range(0, len(ids), TURN):
            # exact stop: the best bound left is below the k-th score; ties go on
            live = live[~self.any[live, -1] | (sorted_limit[live, start] >= self.top[live, -1])]
            if not len(live):
                return
            part = order[live, start : start + TURN]
            score, who = _scores(self.vectors[live], vectors[part]), ids[part]
            self.evaluated += score.size
            use = who != self.ids[live, None]
            self._keep(live, np.where(use, score, np.iinfo(np.int64).min), np.where(use, who, np.iinfo(np.int64).max), use)

    def _keep(self, rows: np.ndarray, score: np.ndarray, who: np.ndarray, use: np.ndarray) -> None:
        score, who, use = (np.concatenate(x, 1) for x in ((self.top[rows], score), (self.who[rows], who), (self.any[rows], use)))
        # candidates that can't displace the k-th are left out of the full sort
        order = np.lexsort((who, -score, ~use), axis=1)[:, : self.k]
        self.top[rows], self.who[rows], self.any[rows] = (np.take_along_axis(x, order, 1) for x in (score, who, use))


def search(vectors: DataFrame, scratch: Scratch, every: int = 50, k: int = 5, pivots: int = PIVOTS, block: int = BLOCK,
           factor: int = 256) -> DataFrame:
    """vec_id, embedding -> query_id, rank, vec_id, score.

    Queries are the rows whose id is divisible by ``every``; candidates are all
    rows but those of the query's own id. Scores are integer inner products of
    the quantised vectors, the ``k`` highest are returned, ties to the smaller
    id; a query with fewer candidates returns them all. Only vectors of the
    query's own length are compared with it. Rows with a null id or a vector
    that takes no part are left out; repeated candidate rows each count;
    repeated query rows count once. Scores beyond the range of a long are
    clamped to it. An empty table gives no rows.

    Pivots are a sample of bounded size, chosen by a hash of the id. The pivot
    table is computed once and written with the candidates; queries then come
    in blocks of ``block`` vectors, each sent to the tasks that hold the
    candidates, whose local best are merged by query.
    """
    spark = vectors.sparkSession
    rows = (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding"), factor).alias("v"))
        .where("vec_id is not null and v is not null").withColumn("dim", F.size("v"))
        .withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    )
    result = None
    for dim, reach2 in sorted((r.dim, r.reach2) for r in rows.groupBy("dim").agg(F.max("norm2").alias("reach2")).collect()):
        # one pass a length; a table of embeddings has one
        part = rows.where(F.col("dim") == dim)
        found = _search_length(spark, part, scratch, f"d{dim}", float(np.sqrt(reach2)), every, k, pivots, block)
        result = found if result is None else result.unionByName(found)
    if result is None:
        result = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return result


def _search_length(spark: SparkSession, rows: DataFrame, scratch: Scratch, name: str, reach: float, every: int, k: int,
                   pivots: int, block: int) -> DataFrame:
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).select("v").collect()
    base = _matrix([r.v for r in chosen]).astype(np.float64)
    lift = np.sqrt(np.maximum(reach**2 - (base**2).sum(1), 0))

    def tabulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = _matrix(pdf["v"]).astype(np.float64)
            table = pivot_distances(x, np.sqrt(np.maximum(reach**2 - (x**2).sum(1), 0)), base, lift)
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "v": pdf["v"], "table": list(table)})

    candidates = scratch.write(
        rows.select("vec_id", "v").mapInPandas(tabulate, "vec_id long, v array<double>, table array<double>"), f"{name}-table")
    queries = candidates.where(F.col("vec_id") % every == 0).select("vec_id", "v").dropDuplicates(["vec_id"])
    parts, held = [], []

    def run(held: list) -> None:
        sent = spark.sparkContext.broadcast((np.array([r.vec_id for r in held], np.int64), _matrix([r.v for r in held])))

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = Block(*sent.value, base, k)
            for pdf in batches:
                for i in range(0, len(pdf), SLAB):
                    few = pdf.iloc[i : i + SLAB]
                    own.feed(few["vec_id"].to_numpy(np.int64), _matrix(few["v"]), np.array(list(few["table"]), np.float64).reshape(len(few), -1), reach)
            hit = own.any.nonzero()
            yield pd.DataFrame({"query_id": own.ids[hit[0]], "vec_id": own.who[hit], "score": own.top[hit]})

        local = candidates.mapInPandas(best, "query_id long, vec_id long, score long")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        merged = local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        parts.append(scratch.write(merged.select("query_id", "rank", "vec_id", "score"), f"{name}-block{len(parts)}"))
        sent.unpersist()

    for row in queries.toLocalIterator():
        held.append(row)
        if len(held) == block:
            run(held)
            held = []
    if held:
        run(held)
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
