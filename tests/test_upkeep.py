"""Upserts with upkeep, versions behind a manifest, and the streamed history."""

from __future__ import annotations

import datetime as dt

import pytest

from tessera.operators import upkeep
from tessera.sources.manifest import Conflict, GuardedTables, Manifest
from tessera.streaming.history import History

D = dt.date
STATUS = "symbol string, status string, valid_from date, valid_to date, announced_at date, source string, confidence string"


def test_status_rows_are_checked_merged_and_retired(spark):
    stored = spark.createDataFrame([
        ("000001", "listed", D(2020, 1, 1), None, None, "old", "medium"), ("000001", "st", D(2021, 1, 1), None, None, "old", "high"), ("000002", "listed", D(2020, 1, 1), None, None, "old", "high"),
        ("000003", "listed", D(2010, 1, 1), None, None, "old", "medium")], STATUS)
    fresh = spark.createDataFrame([
        (1, "sz000001", " ST ", D(2021, 1, 1), D(2022, 1, 1), None, None, None), (2, "1", "st", D(2021, 1, 1), D(2023, 1, 1), None, "feed", "Low"), (3, "000001.SZ", "LISTED", D(2015, 1, 1), None, D(2015, 1, 1), "x", "high"),
        (4, "000001", "listed", D(2018, 1, 1), None, None, "x", "medium"), (5, "000002", "listed", D(2015, 1, 1), None, D(2015, 1, 1), "x", "high"), (6, "000003", "listed", D(2015, 1, 1), None, D(2015, 1, 1), "x", "high"),
        (7, "abc", "halted", D(2020, 1, 1), D(2020, 1, 1), None, "x", "sure"), (8, "000009", None, None, None, None, "x", "high")], "seq long, " + STATUS)
    got = sorted((r.symbol, r.status, r.valid_from.year, r.valid_to and r.valid_to.year, r.source, r.confidence) for r in upkeep.upserted(stored, fresh, "security_status").collect())
    assert got == [
        # the placeholder of 2020 goes, the one of 2018 came after the real listing
        ("000001", "listed", 2015, None, "x", "high"), ("000001", "listed", 2018, None, "x", "medium"), ("000001", "st", 2021, 2023, "feed", "low"),
        # not a placeholder, and one before the listing
        ("000002", "listed", 2015, None, "x", "high"), ("000002", "listed", 2020, None, "old", "high"), ("000003", "listed", 2010, None, "old", "medium"), ("000003", "listed", 2015, None, "x", "high")]
    bad = {r.seq: r.reasons for r in upkeep.rejects(fresh, "security_status").collect()}
    assert bad == {7: "bad_symbol,unknown_word,unknown_confidence,empty_interval", 8: "missing_date,unknown_word"}


def test_other_tables(spark):
    names = spark.createDataFrame([(1, "600000", "n" * 80, D(2020, 1, 1), None), (2, "600000", "new", D(2020, 1, 1), None)], "seq long, symbol string, name string, valid_from date, valid_to date")
    empty = names.drop("seq").limit(0)
    assert [r.name for r in upkeep.upserted(empty, names, "security_name").collect()] == ["new"]
    assert [len(r.name) for r in upkeep.upserted(empty, names.limit(1), "security_name").collect()] == [64]
    weights = spark.createDataFrame([(1, "000300", "1", D(2020, 1, 1), 0.5), (2, "SH000300", "000001", D(2020, 1, 1), None), (3, "x", "1", None, 0.1)], "seq long, index_symbol string, symbol string, trade_date date, weight double")
    assert [tuple(r) for r in upkeep.upserted(weights.drop("seq").limit(0), weights, "index_weight_snapshot").collect()] == [("000300", "000001", D(2020, 1, 1), None)]
    assert upkeep.rejects(weights, "index_weight_snapshot").first().reasons == "bad_symbol,missing_date"


def test_spans(spark):
    rows = [("a", D(2020, 1, 1), D(2020, 2, 1)), ("a", D(2020, 1, 10), D(2020, 1, 12)), ("a", D(2020, 1, 20), D(2020, 1, 25)), ("a", D(2020, 2, 1), D(2020, 2, 5)), ("a", D(2020, 2, 8), None), ("a", D(2021, 1, 1), D(2021, 1, 2))]
    got = sorted((r.span_from.day, r.span_to and r.span_to.day, r.n_rows, r.n_overlaps, r.gap_days) for r in upkeep.spans(spark.createDataFrame(rows, "symbol string, valid_from date, valid_to date")).collect())
    assert got == [(1, 5, 4, 2, None), (8, None, 2, 1, 3)]


def test_one_of_two_writers_commits(spark, tmp_path):
    m = Manifest(spark, f"file://{tmp_path}/m")
    assert m.read() == (-1, {})
    assert m.commit(-1, {"a": 1}) == 0 and m.read() == (0, {"a": 1})
    with pytest.raises(Conflict):
        m.commit(-1, {"a": 2})
    assert m.read() == (0, {"a": 1}) and m.commit(0, {"a": 3}) == 1 and m.read(0) == (0, {"a": 1}) and m.versions() == [0, 1]


def test_tables_appear_together_or_not_at_all(spark, tmp_path):
    tables = GuardedTables(spark, f"file://{tmp_path}/g")
    one, two = spark.createDataFrame([(1,)], "k long"), spark.createDataFrame([(2,)], "k long")
    version, _ = tables.state()
    assert tables.apply(version, {"runs": one, "cemetery": one}) == 0
    with pytest.raises(Conflict):
        tables.apply(version, {"runs": two, "cemetery": two})
    assert tables.table("runs").count() == tables.table("cemetery").count() == 1
    assert tables.apply(0, {"runs": two}, {"cemetery": two}, {"why": "new"}) == 1
    assert sorted(r.k for r in tables.table("runs").collect()) == [1, 2] and [r.k for r in tables.table("cemetery").collect()] == [2]
    assert [r.k for r in tables.table("cemetery", 0).collect()] == [1] and tables.state()[1]["notes"] == {"why": "new"}


SNAPSHOT = "scope string, as_of date, key string, value string"


def test_history_of_snapshots(spark, tmp_path):
    history = History(spark, f"file://{tmp_path}/h", 3)
    take = lambda k, rows: history.write(spark.createDataFrame(rows, SNAPSHOT), k)
    shown = lambda: sorted((r.scope, r.key, r.value, r.valid_from.day, r.valid_to.day if r.valid_to else None) for r in history.table().collect())
    day = lambda d: D(2024, 1, d)
    take(0, [("s", day(1), "a", "x"), ("s", day(1), "b", "x"), ("t", day(1), "a", "x")])
    assert shown() == [("s", "a", "x", 1, None), ("s", "b", "x", 1, None), ("t", "a", "x", 1, None)]
    # two snapshots in one batch: a changes and comes back, b vanishes, c is new; t is left alone
    take(1, [("s", day(3), "a", "y"), ("s", day(5), "a", "x"), ("s", day(5), "c", "z"), ("s", day(5), "c", "w")])
    after = [("s", "a", "x", 1, 3), ("s", "a", "x", 5, None), ("s", "a", "y", 3, 5), ("s", "b", "x", 1, 3), ("s", "c", "z", 5, None), ("t", "a", "x", 1, None)]
    assert shown() == after
    # a batch that is replayed after its commit changes nothing
    take(1, [("s", day(9), "a", "never")])
    assert shown() == after
    # the same day again replaces what it had opened; a snapshot without keys closes all; an older one is late
    take(2, [("s", day(5), "a", "v"), ("t", day(8), None, None), ("u", day(1), "k", "v")])
    assert shown() == [("s", "a", "v", 5, None), ("s", "a", "x", 1, 3), ("s", "a", "y", 3, 5), ("s", "b", "x", 1, 3), ("t", "a", "x", 1, 8), ("u", "k", "v", 1, None)]
    take(3, [("s", day(2), "q", "v"), ("u", day(1), "k", "v")])
    assert ("s", "q", "v", 2, None) not in shown() and [(r.scope, r.key) for r in history.late().collect()] == [("s", "q")]


def test_a_failed_batch_is_written_again(spark, tmp_path, monkeypatch):
    history = History(spark, f"file://{tmp_path}/h", 2)
    first, second = (spark.createDataFrame([("s", D(2024, 1, d), "a", v)], SNAPSHOT) for d, v in ((1, "x"), (2, "y")))
    history.write(first, 0)
    with monkeypatch.context() as m:
        m.setattr(history.manifest, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            history.write(second, 1)
    assert [r.value for r in history.table().collect()] == ["x"]
    history.write(second, 1)
    assert sorted((r.value, r.valid_to is None) for r in history.table().collect()) == [("x", False), ("y", True)]


def test_a_batch_rewrites_only_the_ranges_it_meets(spark, tmp_path):
    history = History(spark, f"file://{tmp_path}/h", 8)
    history.write(spark.createDataFrame([(f"s{k}", D(2024, 1, 1), "a", "x") for k in range(30)], SNAPSHOT), 0)
    before = history.manifest.read()[1]["ranges"]
    history.write(spark.createDataFrame([("s3", D(2024, 1, 2), "a", "y")], SNAPSHOT), 1)
    after = history.manifest.read()[1]["ranges"]
    assert len(before) > 4 and sum(before[r] != after[r] for r in before) == 1 and history.table().count() == 31
