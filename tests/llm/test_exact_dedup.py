import hashlib
from collections import defaultdict

import pandas as pd

from tessera.llm import exact_dedup

WS = dict.fromkeys(map(ord, " \t\n\x0b\x0c\r"))


def brute(rows):
    groups = defaultdict(list)
    for doc, text, *_ in rows:
        groups[(text or "").translate(WS)].append((-len(text or ""), doc is None, doc))
    keep = {k: min(v, key=lambda x: (x[0], x[1], x[2] or 0))[2] for k, v in groups.items()}
    return sorted(((d, keep[n := (t or "").translate(WS)], len(groups[n]), d == keep[n], hashlib.sha256(n.encode()).hexdigest()) for d, t, *_ in rows), key=str)


def test_matches_brute_force(documents, rows):
    got = exact_dedup.exact_dedup(documents).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_survivors_are_one_of_each_group(documents, rows, scratch):
    got = exact_dedup.survivors(documents, scratch)
    assert got.columns == documents.columns
    kept = {(d, t) for d, t, *_ in rows for b in [dict(((x[0], x[4]), x) for x in brute(rows))] if b[(d, hashlib.sha256((t or "").translate(WS).encode()).hexdigest())][3]}
    found = [(r.doc_id, r.text) for r in got.collect()]
    assert sorted(found, key=str) == sorted(kept, key=str)


def test_shuffled_path_gives_the_same(documents, scratch):
    a = exact_dedup.survivors(documents, scratch).select("doc_id").collect()
    from tessera.llm.common import Scratch
    b = exact_dedup.survivors(documents, Scratch(documents.sparkSession), broadcast_rows=-1).select("doc_id").collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_empty_and_clashing_columns(documents, empty):
    assert exact_dedup.exact_dedup(empty).count() == 0
    clash = documents.withColumnRenamed("lang", "kept").withColumnRenamed("source", "group_size")
    assert exact_dedup.exact_dedup(clash).select("kept", "group_size").dtypes == [("kept", "boolean"), ("group_size", "bigint")]


def test_runs_merge_across_batches_and_never_on_the_digest_alone():
    rows = [(0, 7, "d", "p", 3, -9, False, 1, 2), (0, 7, "d", "p", 3, -5, False, 0, 1), (0, 7, "d", "p", 3, -5, True, 0, 4), (0, 7, "d", "q", 3, -5, False, 0, 1), (0, 8, "e", "p", 3, 0, False, 5, 1)]
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in exact_dedup.ENTRY.split(", ")])
    for step in (1, 2, 5):
        out = pd.concat(exact_dedup._collapsed(frame.iloc[i : i + step] for i in range(0, len(frame), step)))
        assert out[["digest", "proof", "id", "n"]].values.tolist() == [["d", "p", 1, 7], ["d", "q", 0, 1], ["e", "p", 5, 1]]
    assert list(exact_dedup._collapsed(iter([frame.iloc[:0]]))) == []


def test_any_number_of_rounds_gives_the_same(documents):
    runs = [sorted(map(str, exact_dedup.digest_groups(documents, fan, rounds).collect())) for fan, rounds in ((4, 2), (2, 3), (3, 1))]
    assert runs[0] == runs[1] == runs[2]
