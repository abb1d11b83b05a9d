import re
from collections import defaultdict

import pytest

from tessera.llm import source_mix
from tessera.llm.common import Scratch


def fill(sizes, weights=(5.0, 2.0, 1.0), cap=2, share=1.5):
    """Water-filling as told: clamp, share the excess by weight, again until none is above."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = budget - sum(fixed.values())
        got = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if got[s] > cap * sizes[s]]
        if not over:
            return fixed | got
        fixed |= {s: float(cap * sizes[s]) for s in over}


def test_targets_and_mass(documents, rows, scratch):
    got = source_mix.mix(documents, scratch).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, biggest = defaultdict(int), defaultdict(int)
    for _, t, _, s, _ in rows:
        sizes[s] += size(t)
        biggest[s] = max(biggest[s], size(t))
    targets, taken = fill(sizes), defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        assert r.size == size(r.text) and r.source_size == sizes[r.source] and r.taken == r.copies * r.size <= 2 * r.size
        assert r.target == pytest.approx(targets[r.source])
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= biggest[s]


def test_reruns_agree(documents, spark):
    runs = [sorted((str(r.doc_id), r.size, r.taken) for r in source_mix.mix(d, Scratch(spark)).collect()) for d in (documents, documents.repartition(3))]
    assert runs[0] == runs[1]


def test_all_sources_equal_and_empty_table(spark, empty, scratch):
    assert source_mix.mix(empty, scratch).count() == 0
    one = spark.createDataFrame([(1, None, "en", "a", 0), (2, "", "en", "b", 0)], "doc_id long, text string, lang string, source string, taken long")
    assert [r.taken for r in source_mix.mix(one, Scratch(spark)).collect()] == [0, 0]


def test_clashing_columns(documents, spark):
    names = ["need", "whole", "cut", "through", "words", "weight", "cap", "budget", "copies", "stop", "level"]
    clash = documents.selectExpr("*", *[f"concat('{n}', doc_id) as {n}" for n in names])
    plain = {(r.doc_id, r.text): r.taken for r in source_mix.mix(documents, Scratch(spark)).collect()}
    got = source_mix.mix(clash, Scratch(spark)).collect()
    assert {(r.doc_id, r.text): r.taken for r in got} == plain
    assert all(r[n] == (f"{n}{r.doc_id}" if r.doc_id is not None else None) for r in got for n in names if n != "copies")
