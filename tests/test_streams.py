"""Streams with state: breakers that survive a restart, news against decisions, empty streams."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import functions as F

from tessera.operators import news, repository
from tessera.session import Folder
from tessera.streaming import feeds, sync

JOB = "target string, job_id long, created_at timestamp, status string"


def at(day: float) -> dt.datetime:
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day)


def fed(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def add(spark, folder, k, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{k}")


def test_breakers_survive_a_restart(spark):
    folder = Folder(spark, "t").root
    batches = [
        [("a", 1, at(0), "failed"), ("a", 2, at(1), "failed"), ("b", 3, at(1), "success"), ("c", 20, at(0), "failed")],
        [("a", 4, at(2), "failed"), ("a", 5, at(3), "success"), ("c", 21, at(2), "failed"), ("c", 22, at(2.5), "failed")],
        [("a", 6, at(40), "success"), ("b", 7, at(41), "failed"), ("b", 9, at(42), "failed"), ("b", 10, at(43), "empty"), ("b", 11, at(44), "success")],
        [("b", 8, at(200), "success")],
        [("b", 12, at(201), "success")],
    ]
    for k, rows in enumerate(batches):
        add(spark, folder, k, rows, JOB)
        with sync.keyed_state(spark):  # each round is a new query over the same checkpoint
            sync.decisions(fed(spark, folder, JOB)).writeStream.outputMode("append").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).format("parquet").option("path", f"{folder}/out").start().awaitTermination()
    rows = spark.read.parquet(f"{folder}/out").collect()
    got = {r.job_id: (r.decision, r.streak) for r in rows if r.job_id}
    assert got == {
        1: ("run", 1), 2: ("run", 2), 3: ("run", 0), 4: ("tripped", 3), 5: ("open", 3), 6: ("run", 0), 7: ("run", 1), 8: ("run", 0), 9: ("run", 2), 10: ("run", 0), 11: ("quota", 0), 12: ("run", 0),
        20: ("run", 1), 21: ("run", 2), 22: ("tripped", 3)}
    # c's breaker closes by its timer; a's was found closed by a later job before
    assert [(r.target, r.at) for r in rows if r.decision == "closed"] == [("c", at(32.5))]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_news_blocks_decisions_and_late_news_does_not(spark):
    folder = Folder(spark, "t").root
    news_schema, decision_schema = "symbol string, known_at timestamp, news_id long", "symbol string, decided_at timestamp"
    for k, (items, decided) in enumerate([
        ([("a", at(0.5), 1), ("a", at(4.9), 2), ("b", at(1), 3)], [("a", at(2)), ("a", at(4)), ("b", at(5)), ("c", at(1))]),
        ([("c", at(1.5), 4), ("z", at(30), 5)], [("z", at(60))]),
        ([("z", at(60), 7)], [("z", at(90))]),
        # known long before the watermark: too late, although it fits a decision
        ([("b", at(4), 6), ("z", at(120), 8)], [("z", at(120))]),
    ]):
        spark.createDataFrame(items, news_schema).coalesce(1).write.parquet(f"{folder}/n/in/{k}")
        spark.createDataFrame(decided, decision_schema).coalesce(1).write.parquet(f"{folder}/d/in/{k}")
    out = feeds.drain(feeds.blocked_decisions(fed(spark, f"{folder}/n", news_schema), fed(spark, f"{folder}/d", decision_schema)), "append")
    got = sorted(((r.symbol, (r.decided_at - at(0)).days, r.news_id) for r in out.collect() if r.symbol != "z"), key=str)
    assert got == [("a", 2, 1), ("a", 4, 2), ("b", 5, None), ("c", 1, 4)]


def test_empty_streams_drain_to_empty_tables(spark):
    folder = Folder(spark, "t").root
    schema = "event_id long, event_type string, value double, ts timestamp"
    spark.createDataFrame([], schema).write.parquet(f"{folder}/in/0")
    events = spark.readStream.schema(schema).parquet(f"{folder}/in/*")
    assert feeds.drain(feeds.windowed_counts(events)).count() == 0 and feeds.drain(feeds.once_each(events), "append").count() == 0


MARKS = "ÃÂâåæçèéï¼½äð"


def clean(text):
    """The rule, letter by letter."""
    def penalty(t):
        return sum(c in MARKS for c in t) + 2 * sum("\x80" <= c <= "\x9f" for c in t)

    tries = [text]
    for code in ("latin1", "cp1252"):
        try:
            tries.append(text.encode(code).decode("utf-8"))
        except UnicodeError:
            pass
    best = max(tries, key=lambda t: 3 * sum("一" <= c <= "鿿" for c in t) - 4 * penalty(t) - 8 * t.count("�"))
    best = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", " ", best)
    return re.sub(r"\s+", " ", best).strip(), penalty(text) >= 2


def test_text_repair_equals_the_rule(spark):
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if r.text]
    chinese = ["国家统计局公布数据", "公司“减持”公告—风险", "naïve café", "Ã©", "a b　c\x1dd\x85e", " x ", "\x81\x8d", "é퟿", "€uro ‚x’", "￿�", "", "  ", "\x00a\x00"]
    texts = [*docs, *chinese]
    for t in [*docs[:60], *chinese[:3]]:
        texts.append(t.encode().decode("latin-1"))
        texts.append(t.encode().decode("cp1252", "ignore"))
    texts += [t[:k] for t in ("å½å®¶统计", "国家".encode().decode("latin-1")) for k in range(8)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", news.clean(F.col("t")).alias("c"), news.has_mojibake(F.col("t")).alias("m")).collect()
    for r in rows:
        assert (r.c, r.m) == clean(texts[r.i]), texts[r.i][:80]
    assert clean("国家".encode().decode("latin-1")) == ("国家", True)
    null = spark.range(1).select(F.lit(None).cast("string").alias("t")).select(news.clean(F.col("t")).alias("c"), news.has_mojibake(F.col("t")).alias("m")).first()
    assert tuple(null) == (None, False)


def test_payloads_are_cleaned_at_every_depth(spark):
    bad = "国家".encode().decode("latin-1")
    df = spark.createDataFrame([(bad, 1, {"k" + bad: [bad, None]}, (bad, [(bad,)])), (None, None, None, None)], "a string, n int, m map<string,array<string>>, s struct<x:string,y:array<struct<z:string>>>")
    first, second = sorted(news.clean_payload(df).collect(), key=lambda r: r.a is None)
    assert first.a == "国家" and first.n == 1 and first.m == {"k国家": ["国家", None]} and first.s.x == "国家" and first.s.y[0].z == "国家"
    assert second.a is None and second.m is None and second.s is None
    keys = spark.createDataFrame([({"a ": "1", "a": "2"},)], "m map<string,string>")
    assert len(news.clean_payload(keys).first().m) == 1


def test_the_resolver_meets_names_by_grams(spark):
    names = [("1", "平安银行"), ("2", "平安"), ("3", "安"), ("4", None), ("5", "aaaa bank"), ("6", "bank aa"), ("7", "%_x")]
    stocks = spark.createDataFrame([(s.zfill(6), n) for s, n in names], "symbol string, name string")
    texts = ["安", "平安", "安银行", "aa", "aaa", "bank", "k a", "zzz", "zz", "_", "%", "", "000005", "aaaa bank", "银 行"]
    found = repository.names_with(stocks, spark.createDataFrame([(t,) for t in texts], "text string"))
    want = {(t, s.zfill(6)) for t in texts if t for s, n in names if n and t in n}
    assert {(r.text, r.symbol) for r in found.collect()} == want
    out = repository.resolve(stocks, spark.createDataFrame([(t,) for t in [*texts, None]], "text string"))
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.text: (r.symbol, r.rule) for r in out.collect()}
    assert got["安"] == ("000003", "name") and got["安银行"] == ("000001", "contains") and got["bank"] == (None, "ambiguous") and got[""] == got["zzz"] == (None, "unknown") and got["000005"] == ("000005", "code")
