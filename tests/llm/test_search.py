import math
import random

import pytest

from tessera.llm import pivot_search
from tessera.llm.common import Scratch

SCHEMA = "vec_id long, embedding array<float>, rank int"


def brute(rows, every=50, k=5):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {i: v for i, v in ok if i % every == 0}.items():
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q and len(w) == len(v))[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def make(n, dim, seed, spread=1.0):
    rng = random.Random(seed)
    rows = [(i, [float(f"{rng.gauss(0, spread):.3f}") for _ in range(dim)], 0) for i in range(n)]
    rows = [(i, [float(__import__("numpy").float32(x)) for x in v], r) for i, v, r in rows]
    for i in range(10, 60):
        rows[i] = (i, rows[10][1], 0)
    rows += [(1000, None, 0), (1050, [float("nan")] * dim, 0), (1100, [None] + [0.0] * (dim - 1), 0), (None, rows[0][1], 0), (1150, [float("inf")] * dim, 0), (1200, [0.5] * 3, 0), (1201, [0.25] * 3, 0), (3, rows[3][1], 0)]
    return rows


@pytest.mark.parametrize(("block", "pivots"), [(1024, 48), (2, 3), (1, 1)])
def test_matches_brute_force(spark, scratch, block, pivots):
    rows = make(260, 9, 4)
    got = pivot_search.search(spark.createDataFrame(rows, SCHEMA).repartition(3), scratch, block=block, pivots=pivots)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == brute(rows)


def test_few_candidates_and_empty(spark, scratch):
    rows = [(0, [1.0, 2.0], 0), (7, [1.0, -2.0], 0), (50, [], 0), (51, [], 0)]
    assert sorted(map(tuple, pivot_search.search(spark.createDataFrame(rows, SCHEMA), scratch).collect())) == brute(rows)
    assert pivot_search.search(spark.createDataFrame([], SCHEMA), Scratch(spark)).count() == 0


def test_large_components_stay_exact(spark, scratch):
    rows = [(i, [float(i * 1e5), 3e6, -2e6 * (i % 3)], 0) for i in range(0, 120, 5)]
    got = pivot_search.search(spark.createDataFrame(rows, SCHEMA), scratch)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_components_of_any_finite_size_take_part(spark, scratch):
    rows = [(0, [1.0, 2.0], 0), (1, [1e17, 0.0], 0), (2, [-1e17, 3.0], 0), (3, [2.0**45 + 0.0078125, 1.0], 0), (4, [3e38, -3e38], 0), (50, [1e30, 1e30], 0), (51, [0.5, 0.25], 0), (100, [2.0, -1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = sorted(map(tuple, pivot_search.search(df, scratch).collect()))
    clamp = lambda s: max(-(2**63), min(2**63 - 1, s))
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows]
    want = []
    for q, v in [r for r in ok if r[0] % 50 == 0]:
        best = sorted((-clamp(sum(a * b for a, b in zip(v, w))), i) for i, w in ok if i != q)[:5]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)
    assert any(r[0] == 0 and r[2] == 1 for r in got)


def test_clashing_columns_and_the_query(spark, tmp_path):
    from tessera.llm import queries

    rows = [(i, [float(i % 7), 1.0], i) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int").selectExpr("*", "1 as score", "2 as query_id", "3 as v", "4 as dim", "5 as norm2")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op1_pivot_search(spark, str(tmp_path))
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_bounds_eliminate():
    import numpy as np

    rng = np.random.default_rng(0)
    centers = rng.normal(size=(20, 4)) * 300
    x = np.round(centers[rng.integers(0, 20, 4000)] + rng.normal(size=(4000, 4))).astype(np.int64)
    reach = float(np.sqrt((x.astype(float) ** 2).sum(1).max()))
    pivots = x[:32].astype(float)
    lift = np.sqrt(np.maximum(reach**2 - (pivots**2).sum(1), 0))
    block = pivot_search.Block(np.arange(40), x[:40], pivots, 5)
    table = pivot_search.pivot_distances(x.astype(float), np.sqrt(np.maximum(reach**2 - (x.astype(float) ** 2).sum(1), 0)), pivots, lift)
    block.feed(np.arange(4000), x, table, reach)
    assert block.evaluated < 40 * 4000 / 2
