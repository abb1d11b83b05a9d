"""Readers, normalisers, sinks, text repair and the streaming breaker."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import news, pit, repository
from tessera.sources import files, sinks
from tessera.streaming import feeds


def test_column_names_of_providers(spark):
    raw = spark.createDataFrame([(dt.date(2024, 1, 2), 1.0, 2.0, 0.5, 1.5, 10.0, 15.0, "x")], "`日期` date, `开盘` double, `最高` double, `最低` double, `收盘` double, `成交量` double, `成交额` double, other string")
    assert files.normalize_columns(raw).columns == ["trade_date", "open", "high", "low", "close", "volume", "amount"]
    other = raw.toDF("tradeDate", "open_price", "highPrice", "low", "收盘价", "vol", "amt", "复权")
    assert files.normalize_columns(other).columns == ["trade_date", "open", "high", "low", "close", "volume", "amount", "adj"]
    with pytest.raises(ValueError, match="close"):
        files.normalize_columns(raw.drop("收盘"))


def test_symbols(spark):
    given = ["1", " sh600000", "600000.SH", "SZ.000001", "abc", "1234567", None]
    got = [r[0] for r in spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, s string").orderBy("i").select(repository.normalize_symbol(F.col("s"))).collect()]
    assert got == ["000001", "600000", "600000", "000001", None, None, None]


def test_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "scores.csv")
    (tmp_path / "scores.csv").write_text("trade_date,symbol,score,extra\n2024-01-01,1.0,0.5,x\n2024-01-02,000002,bad,y\n")
    rows = files.read_csv(spark, path, "scores").orderBy("trade_date").collect()
    assert [(r.symbol, r.score) for r in rows] == [("000001", 0.5), ("000002", None)]
    with pytest.raises(ValueError, match="gap_type"):
        files.read_csv(spark, path, "gaps")


def test_report_and_parameters(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"runs": [{"equity_curve": [{"trade_date": "2024-01-01", "equity": 1.0, "drawdown": 0.0}], "benchmark_curve": [{"trade_date": "2024-01-01", "equity": 2.0}]}]}))
    assert files.read_report(spark, str(tmp_path / "r.json")).first().benchmark == 2.0
    assert files.parse_parameter("a = true") == ("a", True) and files.parse_parameter("n=3") == ("n", 3) and files.parse_parameter("x=0.5") == ("x", 0.5) and files.parse_parameter("s=q") == ("s", "q")
    assert files.parameter_grid('[{"a": 1}]') == [{"a": 1}]
    for bad in ("noequals", "=1"):
        with pytest.raises(ValueError):
            files.parse_parameter(bad)


def test_sinks(spark, tmp_path):
    bars = spark.createDataFrame([("000001", dt.date(2023 + i, 1, 2), *([float(i + 1)] * 6)) for i in range(3)], "symbol string, trade_date date, open double, high double, low double, close double, volume double, amount double")
    sinks.write_bars(bars, str(tmp_path / "bars"))
    sinks.write_bars(bars.where("year(trade_date) = 2024").withColumn("close", F.lit(9.0)), str(tmp_path / "bars"))
    assert {r.close for r in spark.read.parquet(str(tmp_path / "bars")).collect()} == {1.0, 9.0, 3.0}
    assert sinks.content_fingerprint(bars) == sinks.content_fingerprint(bars.orderBy(F.desc("trade_date"))) != sinks.content_fingerprint(bars.limit(2))
    assert sinks.fingerprint({"b": 1, "a": 2}) == sinks.fingerprint({"a": 2, "b": 1})
    sinks.write_text(bars, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 3
    assert sinks.markdown(bars.select("symbol").limit(1)) == "| symbol |\n|---|\n| 000001 |"


def test_text_repair(spark):
    texts = ["公司公告".encode().decode("latin-1"), "plain  text\n\x01", None, "café", "立案".encode().decode("latin-1"), "a  b"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(news.clean(F.col("t")).alias("t")).collect()
    assert [r.t for r in rows] == ["公司公告", "plain text", None, "café", "立案", "a b"]
    c = spark.createDataFrame([("利好 破产",), ("终止上市",), (None,)], "t string").select(news.classify(F.col("t")).alias("c")).collect()
    assert [r.c.event_type for r in c] == ["neutral", "severe_company_risk", "neutral"]


def test_late_announcements_do_not_hide(spark):
    d = dt.date
    rows = [("a", "normal", d(2024, 1, 1), None, d(2024, 1, 1)), ("a", "st", d(2024, 2, 1), None, d(2024, 3, 1))]
    status = spark.createDataFrame(rows, "symbol string, status string, valid_from date, valid_to date, announced_at date")
    asks = spark.createDataFrame([("a", d(2024, 2, 15)), ("a", d(2024, 3, 2)), ("b", d(2024, 3, 2))], "symbol string, as_of date")
    assert {(r.symbol, str(r.as_of)): r.status for r in pit.interval_join(asks, status).collect()} == {("a", "2024-02-15"): "normal", ("a", "2024-03-02"): "st", ("b", "2024-03-02"): None}


def test_breaker_and_upsert_sink(spark, tmp_path):
    jobs = spark.createDataFrame([("a", "failed", 1), ("a", "failed", 2), ("b", "failed", 1), ("b", "success", 2)], "target string, status string, created_at long")
    jobs.write.parquet(str(tmp_path / "jobs"))
    stream = spark.readStream.schema(jobs.schema).parquet(str(tmp_path / "jobs"))
    got = {r.target: (r.failures, r.open) for r in feeds.drain(feeds.failure_breaker(stream, 2), "update").collect()}
    assert got == {"a": (2, True), "b": (0, False)}
    write = feeds.merge_into(str(tmp_path / "news"))
    schema = "source string, news_id long, title string, fetched_at long"
    write(spark.createDataFrame([("s", 1, "old", 5)], schema), 0)
    write(spark.createDataFrame([("s", 1, "new", 9), ("s", 2, "x", 9)], schema), 1)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "news/v1")).collect())) == [("s", 1, "new", 5), ("s", 2, "x", 9)]
