"""The audit of sources against a plain recount and its SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np

from tessera.llm import queries, source_audit
from tessera.llm.common import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows):
    docs = [((t or ""), (lang or ""), (s or "")) for _, t, lang, s, _ in rows]
    lower = {c: c + 32 for c in range(65, 91)}
    found = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(lower)), lang, s) for t, lang, s in docs]
    df, groups = defaultdict(Counter), defaultdict(dict)
    for terms, lang, s in found:
        df[lang].update(set(terms))
        groups[lang].setdefault(s, Counter()).update(terms)
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in df[lang].items() if n >= 10)
        counts = {s: {t: c[t] for t in kept} for s, c in sources.items()}
        whole = {t: sum(c[t] for c in counts.values()) for t in kept}
        share = lambda c: {t: 1 + 10**9 * (n + 2) // (sum(c.values()) + 2 * len(kept)) for t, n in c.items()}
        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:10])):
                out += [(lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(items, 1)]
    return sorted(out)


def made(rng, rows):
    vocabulary = ["the", "The", "naïve", "日本", "é", "z", "a", "ab", "Ａ", "\U0001F600x", "ß"] + [f"w{chr(97 + i)}" for i in range(20)]
    out = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 40))), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "é", "z", None]), 0) for i in range(160)]
    out += [(900, None, "fr", "s1", 0), (901, "", "fr", "s2", 0), (902, "one only", "it", "s1", 0), (903, "123 !", "en", "alone", 0)]
    return [*rows, *out, out[3], out[3]]


def test_matches_a_recount(spark, rows, scratch, monkeypatch):
    every = made(random.Random(3), rows)
    docs = spark.createDataFrame(every, SCHEMA).repartition(4)
    want = brute(every)
    assert sorted(map(tuple, source_audit.audit(docs, scratch).collect())) == want
    monkeypatch.setattr(source_audit, "CHUNK", 4)
    monkeypatch.setattr(source_audit, "HELD", 10)
    assert sorted(map(tuple, source_audit.audit(docs, Scratch(spark)).collect())) == want
    assert {r[2] for r in want} == {"pair", "term"} and any(r[0] == "fr" and r[4] == 0 for r in want)


def test_clashing_columns_and_empty_table(spark, empty, scratch):
    assert source_audit.audit(empty, scratch).count() == 0
    docs = spark.createDataFrame([(f"x y {i % 3}", "l", f"s{i % 2}", "t", 1) for i in range(24)], "text string, lang string, source string, term string, chunk int")
    assert sorted(map(tuple, source_audit.audit(docs, Scratch(spark)).collect())) == brute([(None, r[0], r[1], r[2], 0) for r in docs.collect()])


def test_shares_are_exact_beyond_doubles():
    rng = random.Random(1)
    total = [rng.randint(1, 9 * 10**15) for _ in range(200)]
    counts = [rng.randint(0, t) for t in total]
    assert source_audit.shares(np.array(counts), np.array(total)).tolist() == [1 + 10**9 * c // t for c, t in zip(counts, total, strict=True)]


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.op12_source_audit(spark, sf)
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(queries.oracle_sql()["op12_source_audit"]).fetchall())
