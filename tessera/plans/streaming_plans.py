"""Streaming queries drained over the events table, and table upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import news as N
from tessera.plans.news_plans import _CLASSED, _classed
from tessera.plans.repository_plans import _JOBS, jobs
from tessera.session import Folder
from tessera.sources import sinks
from tessera.sources.tables import SQL_BARS, SQL_NEWS, SQL_STOCKS, bars, load, stocks
from tessera.streaming import feeds, sync
from tessera.streaming.history import History


def stream_hourly_counts(spark, sf_dir):
    """Tumbling windows."""
    out = feeds.drain(feeds.windowed_counts(feeds.event_stream(spark, sf_dir)))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_sliding_counts(spark, sf_dir):
    """Sliding windows of three days by a day."""
    out = feeds.drain(feeds.windowed_counts(feeds.event_stream(spark, sf_dir), "3 days", "1 day"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def stream_once_each(spark, sf_dir):
    """Deduplicated deliveries."""
    events = feeds.event_stream(spark, sf_dir)
    twice = events.unionByName(events.where("event_id % 2 = 0"))
    return feeds.drain(feeds.once_each(twice), "append").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def stream_sessions(spark, sf_dir):
    """User sessions with a gap of six hours."""
    out = feeds.drain(feeds.sessions(feeds.event_stream(spark, sf_dir), "6 hours"))
    return out.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


def replace_bars(spark, sf_dir):
    """Bars after a range of two symbols was replaced."""
    b = bars(spark, sf_dir)
    fresh = b.withColumn("close", F.col("close") * 2)
    return sinks.replace_range(b, fresh, ["000003", "000004"], "1997-01-01", "1998-12-31").select("symbol", "trade_date", "close")


def upsert_stocks(spark, sf_dir):
    """The security master after a merge."""
    s = stocks(spark, sf_dir)
    return sinks.merge(s.where("symbol <= '000060'"), s.where("symbol >= '000050'").withColumn("status", F.lit("fresh")), ["symbol"])


def append_once(spark, sf_dir):
    """Outcomes of a target in a year that are not logged yet, by fingerprint."""
    j = jobs(spark, sf_dir).withColumn("fingerprint", F.sha2(F.concat_ws("|", "target", "status", F.year("created_at").cast("string")), 256))
    return sinks.append_once(j.where("job_id % 5 <> 0"), j.where("job_id % 5 = 0")).select("fingerprint")


def _snapshots(spark, sf_dir):
    """A snapshot a month and priority of orders: who ordered, and their last order's status."""
    o = load(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("scope"), F.trunc("o_orderdate", "month").alias("as_of"), F.col("o_custkey").cast("string").alias("key"), "o_orderkey", "o_orderstatus")
    return o.groupBy("scope", "as_of", "key").agg(F.max_by("o_orderstatus", "o_orderkey").alias("value"))


def _in_parts(spark, rows, by, folder):
    """Rows as a stream of one file for each value of ``by``, in its order."""
    values = [r[0] for r in rows.select(by).distinct().orderBy(by).collect()]
    for k, value in enumerate(values):
        rows.where(by.eqNullSafe(value)).coalesce(1).write.parquet(f"{folder}/{k:03d}")
    rows.limit(0).write.parquet(f"{folder}/none")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def stream_sync_decisions(spark, sf_dir):
    """What is done about each sync job, in the order of the log: run, tripped, open or quota."""
    folder = Folder(spark, "sync")
    log = jobs(spark, sf_dir).withColumn("created_at", F.col("created_at").cast("timestamp"))
    stream = _in_parts(spark, log, F.floor(F.year("created_at") / 3), folder.path("in"))
    with sync.keyed_state(spark):
        made = feeds.drain(sync.decisions(stream), "append")
    return made.where("job_id is not null").select("target", "job_id", "decision", F.col("streak").cast("long").alias("streak"))


def stream_news_blocks(spark, sf_dir):
    """Every user's daily decisions with the severe news that blocks them, both as streams; a last row far ahead lets all watermarks pass."""
    folder = Folder(spark, "blocks")
    end = "timestamp'2030-01-01'"
    news = N.risky(_classed(spark, sf_dir)).select("symbol", F.col("known_at").cast("timestamp").alias("known_at"), "news_id")
    decided = load(spark, sf_dir, "events").select(F.lpad(F.col("user_id").cast("string"), 6, "0").alias("symbol"), F.date_trunc("day", F.col("ts").cast("timestamp")).alias("decided_at")).distinct()
    last = lambda rows, at, **more: rows.unionByName(spark.range(1).select(F.lit("end").alias("symbol"), F.expr(end).alias(at), *(v.alias(k) for k, v in more.items())))
    both = [
        _in_parts(spark, last(rows, at, **more), F.floor(F.least(F.dayofyear(at), F.lit(99)) / 12) + F.year(at), folder.path(at))
        for rows, at, more in ((news, "known_at", {"news_id": F.lit(-1).cast("long")}), (decided, "decided_at", {}))]
    found = feeds.drain(feeds.blocked_decisions(*both, delay="20 days"), "append").where("symbol <> 'end'")
    return found.select(F.to_date("decided_at").alias("decision_date"), "symbol", "news_id")


def stream_scd2(spark, sf_dir):
    """The history of monthly snapshots that come two years at a time as a stream; the first ones come again at the end, too late."""
    folder = Folder(spark, "scd2")
    rows = _snapshots(spark, sf_dir).withColumn("part", F.floor(F.year("as_of") / 2))
    first, last = rows.agg(F.min("part"), F.max("part")).first()
    for k, part in enumerate([*range(first, last + 1), first] if first else []):
        # one file each, so that the file source gives them in order
        rows.where(F.col("part") == part).drop("part").coalesce(1).write.parquet(folder.path(f"in/{k:03d}"))
    history = History(spark, folder.path("table"), 4)
    if first:
        schema = "scope string, as_of date, key string, value string"
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder.path("in/*"))
        stream.writeStream.option("checkpointLocation", folder.path("check")).trigger(availableNow=True).foreachBatch(history.write).start().awaitTermination()
    return history.table().select("scope", "key", "value", "valid_from", "valid_to")


QUERIES = {f.__name__: f for f in (stream_scd2, stream_sync_decisions, stream_news_blocks, stream_hourly_counts, stream_sliding_counts, stream_once_each, stream_sessions, replace_bars, upsert_stocks, append_once)}
ORACLE = {
    "stream_sync_decisions": f"""WITH RECURSIVE {_JOBS}, j AS (SELECT *, epoch_ms(CAST(created_at AS TIMESTAMP)) AS now, row_number() OVER (PARTITION BY target ORDER BY created_at, job_id) AS rn FROM jobs),
r AS (SELECT target, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS job_id, '' AS decision, CAST(0 AS BIGINT) AS streak, CAST(0 AS BIGINT) AS until, CAST([] AS BIGINT[]) AS recent FROM (SELECT DISTINCT target FROM jobs)
  UNION ALL SELECT target, rn, job_id, CASE WHEN tripped THEN 'tripped' ELSE decision END, streak, CASE WHEN tripped THEN now + {sync.COOL_DAYS * 86_400_000} ELSE until END, CASE WHEN decision = 'run' THEN list_append(recent, now) ELSE recent END FROM (
    SELECT *, decision = 'run' AND streak >= {sync.MOST_FAILURES} AS tripped FROM (
      SELECT target, rn, job_id, now, until, recent, decision, CASE WHEN decision <> 'run' THEN streak WHEN status = 'failed' THEN streak + 1 ELSE 0 END AS streak FROM (
        SELECT *, CASE WHEN until > 0 THEN 'open' WHEN len(recent) >= {sync.QUOTA} THEN 'quota' ELSE 'run' END AS decision FROM (
          SELECT j.target, j.rn, j.job_id, j.now, j.status, CASE WHEN r.until > 0 AND j.now >= r.until THEN 0 ELSE r.until END AS until, CASE WHEN r.until > 0 AND j.now >= r.until THEN 0 ELSE r.streak END AS streak,
            list_filter(r.recent, lambda t: t > j.now - {sync.QUOTA_DAYS * 86_400_000}) AS recent FROM r JOIN j ON j.target = r.target AND j.rn = r.rn + 1)))))
SELECT target, job_id, decision, streak FROM r WHERE rn > 0""",
    "stream_news_blocks": f"""WITH {SQL_NEWS}, {_CLASSED}, d AS (SELECT DISTINCT lpad(CAST(user_id AS VARCHAR), 6, '0') AS symbol, CAST(ts AS DATE) AS decision_date FROM events)
SELECT d.decision_date, d.symbol, k.news_id FROM d LEFT JOIN k ON k.symbol = d.symbol AND event_type = 'severe_company_risk' AND known_at >= CAST(decision_date - 3 AS TIMESTAMP) AND known_at < CAST(decision_date + 1 AS TIMESTAMP)""",
    "stream_scd2": """WITH s AS (SELECT o_orderpriority AS scope, CAST(date_trunc('month', o_orderdate) AS DATE) AS as_of, CAST(o_custkey AS VARCHAR) AS key, arg_max(o_orderstatus, o_orderkey) AS value FROM orders GROUP BY 1, 2, 3),
d AS (SELECT scope, as_of, row_number() OVER (PARTITION BY scope ORDER BY as_of) AS place FROM (SELECT DISTINCT scope, as_of FROM s)),
p AS (SELECT s.*, d.place FROM s JOIN d USING (scope, as_of)),
f AS (SELECT *, lag(place) OVER w IS DISTINCT FROM place - 1 OR lag(value) OVER w <> value AS fresh FROM p WINDOW w AS (PARTITION BY scope, key ORDER BY place)),
g AS (SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY scope, key ORDER BY place) AS stretch FROM f),
r AS (SELECT scope, key, any_value(value) AS value, min(as_of) AS valid_from, max(place) + 1 AS place FROM g GROUP BY scope, key, stretch)
SELECT r.scope, r.key, r.value, r.valid_from, d.as_of AS valid_to FROM r LEFT JOIN d ON d.scope = r.scope AND d.place = r.place""",
    "stream_hourly_counts": "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "stream_sliding_counts": "SELECT CAST(CAST(ts AS DATE) - k AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events CROSS JOIN (VALUES (0), (1), (2)) o(k) GROUP BY ALL",
    "stream_once_each": "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1",
    "stream_sessions": """WITH m AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS first FROM events),
s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM m) SELECT user_id, CAST(min(ts) AS TIMESTAMP) AS start, count(*) AS n FROM s GROUP BY user_id, sid""",
    "replace_bars": f"WITH {SQL_BARS} SELECT symbol, trade_date, CASE WHEN symbol IN ('000003', '000004') AND trade_date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' THEN close * 2 ELSE close END AS close FROM bars",
    "upsert_stocks": f"WITH {SQL_STOCKS} SELECT symbol, name, exchange, list_date, CASE WHEN symbol >= '000050' THEN 'fresh' ELSE status END AS status FROM stocks",
    "append_once": f"WITH {_JOBS}, f AS (SELECT job_id, sha256(target || '|' || status || '|' || year(created_at)) AS fingerprint FROM jobs) SELECT DISTINCT fingerprint FROM f WHERE job_id % 5 = 0 AND fingerprint NOT IN (SELECT fingerprint FROM f WHERE job_id % 5 <> 0)",
}
