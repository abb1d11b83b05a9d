import random
import re

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import shingle_join, shingles
from tessera.llm.common import Scratch
from tessera.llm.components import components


def word_sets(rows):
    out = []
    for doc, text, *_ in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        out.append((doc, frozenset([tuple(w)] if 0 < len(w) < 5 else (tuple(w[i : i + 5]) for i in range(len(w) - 4)))))
    return out


def brute(rows):
    items = word_sets(rows)
    group = list(range(len(items)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, (_, a) in enumerate(items):
        for j in range(i):
            b = items[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                group[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, s) in enumerate(items):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(s), least.get(root(i)) if s else d) for i, (d, s) in enumerate(items)), key=str)


def test_matches_brute_force(documents, rows, scratch):
    got = shingle_join.near_duplicates(documents, scratch).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_chains_of_near_copies(spark, scratch):
    rng = random.Random(3)
    text = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(text), "en", "s", 0))
        text = list(text)
        text[rng.randrange(80)] = f"v{rng.randrange(10**6)}"
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long")
    got = shingle_join.near_duplicates(docs, scratch).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert shingle_join.one_of_each(docs, Scratch(spark)).count() == len({r[2] for r in brute(rows)})


def test_repeated_rows_lose_no_link(spark, monkeypatch):
    rng = random.Random(4)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    # nodes are numbered by their rows, so the hub is the least
    hub, one, two = (fresh(60) for _ in range(3))
    texts = [hub, one, [*one[:-1], "x"], two, [*two[:-1], "y"]]
    # the hub meets each pair in a cell of the same size; the leaders find nothing, so the trees must find both links
    cells = F.when(F.col("doc_id") == 0, F.array(F.lit(1), F.lit(2))).when(F.col("doc_id") < 3, F.array(F.lit(1))).otherwise(F.array(F.lit(2)))
    monkeypatch.setattr(shingle_join, "features", lambda d, f=shingle_join.features: f(d).withColumn("keys", cells.cast("array<long>")))
    monkeypatch.setattr(shingle_join, "_allowed", lambda pairs, points, f=shingle_join._allowed: f(pairs, points).where("false"))
    rows = [(i, " ".join(t), "en", "s", 0) for i, t in enumerate(texts)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long")
    got = shingle_join.near_duplicates(docs, Scratch(spark)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_cut_cells_lose_no_link(documents, rows, scratch, monkeypatch):
    monkeypatch.setattr(shingle_join, "TREE", 2)
    got = shingle_join.near_duplicates(documents, scratch).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)


def test_empty(empty, scratch):
    assert shingle_join.near_duplicates(empty, scratch).count() == 0


def test_tree_leaves_every_possible_pair():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 9, (30, 16))
    counts = np.concatenate([base, np.abs(base + rng.integers(-1, 2, base.shape))]).astype(np.uint8)
    counts[3], counts[33] = 255, 255
    sizes, roots = counts.sum(1, dtype=np.int64), np.arange(60) // 2
    a, b = shingle_join.CountTree(counts, sizes, roots).join()
    got = {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist())}
    want = set()
    for i in range(60):
        for j in range(i):
            low = np.minimum(counts[i], counts[j])
            bound = 10**9 if (low == 255).any() else int(low.sum())
            if roots[i] != roots[j] and 9 * bound >= 4 * (sizes[i] + sizes[j]) and 5 * sizes[i] >= 4 * sizes[j] and 5 * sizes[j] >= 4 * sizes[i]:
                want.add((j, i))
    assert want == got


def test_shingles_equal_words():
    texts = ["a b c d e f a b c d e", "A B c D e", "x", "", "é b c d e f", "a  b\tc\nd\x0be\x0cf\rg"]
    for t in texts:
        assert shingles.shingle_set(t).shape[1] == len(word_sets([(0, t)])[0][1])
    assert (shingles.shingle_set("A b C d e") == shingles.shingle_set("a B c\nd  e")).all()


def test_words_with_one_rolling_hash_stay_apart(spark, scratch):
    # a word and its letters exchanged agree in every polynomial modulo 2 ** 64
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    tail = " ".join(f"w{i}" for i in range(4))
    rows = [(i, t, "en", "s", 0) for i, t in enumerate([word, other, f"{word} {tail}", f"{other} {tail}", word.upper()])]
    got = shingle_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long"), scratch).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 0), (1, 1, 1), (2, 1, 2), (3, 1, 3), (4, 1, 0)]


def test_clashing_columns(documents, rows, scratch):
    names = ["node", "key", "n", "row", "digest", "counts", "size", "root", "a", "b", "text_a", "draw", "earlier"]
    clash = documents.selectExpr("*", *[f"'{n}' as {n}" for n in names])
    got = shingle_join.near_duplicates(clash, scratch).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    kept = shingle_join.one_of_each(clash, Scratch(clash.sparkSession))
    assert kept.columns == clash.columns and kept.where("node = 'node' and earlier = 'earlier'").count() == kept.count()


def test_components_of_paths_and_stars(spark, scratch):
    edges = [(i, i + 1) for i in range(30)] + [(100, x) for x in range(101, 140)] + [(200, 200), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long"), scratch, "t").collect()))
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 140)}


def test_shingles_are_told_apart_by_both_halves():
    from tessera.llm import shingles

    rows = np.array([[5, 5, 1, 5, 9], [1, 2, 3, 1, 7]], np.uint64)
    one = shingles._distinct(rows)
    assert one.T.tolist() == [[1, 3], [5, 1], [5, 2], [9, 7]]
    other = shingles._distinct(np.array([[5, 9, 5], [2, 7, 8]], np.uint64))
    assert shingles.overlap(one, other) == shingles.overlap(other, one) == 2
    plain = shingles._distinct(np.array([[9, 1, 9], [7, 3, 7]], np.uint64))
    assert plain.T.tolist() == [[1, 3], [9, 7]] and shingles.overlap(one, plain) == 2


def test_first_pairs_of_a_cell_grow_with_its_nodes():
    a, b = (x.ravel() for x in np.meshgrid(np.arange(300), np.arange(300, 600)))
    keep = shingle_join.picked(a, b, shingle_join.PICKED)
    assert keep.sum() <= shingle_join.PICKED * 600 and set(a[keep]) | set(b[keep]) == set(range(600))
