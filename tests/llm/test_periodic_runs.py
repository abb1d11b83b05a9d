"""Runs of words against a brute-force search, and the query's digests."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tessera.llm import periodic_runs, queries


def brute(words):
    """Every maximal run: for each period, the stretches in which words that far apart agree."""
    out, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            part = words[i : i + length]
            if length >= max(6, 4 * q) and not any(part[d:] == part[: length - d] for d in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(words, doc):
    h, n = zlib.crc32(str(doc).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected(doc, text):
    words = planted((text or "").encode().split() if text else [], doc) if doc is not None else (text or "").encode().split()
    runs = brute(words)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc, len(runs), *shown, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_many_texts_at_once(seed):
    rng, texts = random.Random(seed), []
    for _ in range(40):
        n = rng.choice([0, 3, 6, rng.randint(1, 60), rng.randint(1, 200)])
        words = [rng.randint(0, rng.choice([1, 2, 5, 40])) for _ in range(n)]
        kind = rng.randint(0, 3)
        if kind == 1:
            words = periodic_runs.planted_tail(words, 10 * rng.randint(0, 10**6))
        if kind == 2:
            at, block = rng.randint(0, n), [rng.randint(0, 3) for _ in range(rng.randint(1, 7))]
            words = words[:at] + block * rng.randint(1, 12) + words[at:]
        if kind == 3:
            a, b = [0], [0, 1]
            while len(b) < n:
                a, b = b, b + a
            words = b
        texts.append(words)
    flat = np.array([w for t in texts for w in t], np.int64)
    text, *rest = periodic_runs.find_runs(flat, np.array([len(t) for t in texts]))
    got = list(zip(text.tolist(), *(r.tolist() for r in rest), strict=True))
    assert got == [(k, *r) for k, t in enumerate(texts) for r in brute(t)]


def test_query_on_awkward_rows(spark, tmp_path, rows):
    more = [(500 + i, " ".join(["la"] * i), "en", "s", 1) for i in range(12)] + [(900, "a b " * 40 + "\u00a0c " + "x y z " * 9, "en", "s", 1)]
    spark.createDataFrame([*rows, *more], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_periodic_runs(spark, str(tmp_path))
    assert got.dtypes == [("doc_id", "bigint"), *((c, "bigint") for c in ("n_runs", "start", "length", "period", "exponent_milli")), ("runs_sha256", "string"), ("collapsed_sha256", "string")]
    want = [expected(d, t) for d, t, *_ in [*rows, *more]]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert sum(w[1] for w in want) > 10


def test_query_on_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: tuple(r) for r in queries.op11_periodic_runs(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        if len(r.text or "") < 4000:
            assert got[r.doc_id] == expected(r.doc_id, r.text)


def test_operator_alone(spark, empty):
    df = spark.createDataFrame([("x y x y x y x y z", "clash"), (None, ""), ("", "")], "text string, runs string")
    rows = df.select(periodic_runs.run_column(df.text).alias("r")).collect()
    assert [(tuple(map(tuple, r.r.runs)), r.r.strongest and tuple(r.r.strongest), r.r.collapsed) for r in rows] == [(((0, 8, 2),), (0, 8, 2), "x y z"), ((), None, ""), ((), None, "")]
    assert empty.select(periodic_runs.run_column(empty.text)).count() == 0


def test_a_long_period_costs_little():
    words = periodic_runs.planted_tail(list(range(6000)), 30)
    assert [x.tolist() for x in periodic_runs.find_runs(np.array(words), np.array([6000]))] == [[0], [3], [5997], [1000]]
