"""Structured Streaming over news and event feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.news import upsert
from tessera.operators.pit import last_wins
from tessera.session import Folder


def event_stream(spark: SparkSession, folder: str, files: int = 4) -> DataFrame:
    """The events files of a folder as a stream with event time ``ts``."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/events.parquet*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def once_each(events: DataFrame, delay: str = "3 days") -> DataFrame:
    """First delivery of each item; state is kept for the watermark's delay alone."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def windowed_counts(events: DataFrame, length: str = "1 hour", slide: str | None = None, delay: str = "3 days") -> DataFrame:
    """Items and mean value by window and type; later than the delay, a window is final."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.withWatermark("ts", delay).groupBy(window, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "3 days") -> DataFrame:
    """Items by user session."""
    return events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


def blocked_decisions(news: DataFrame, decisions: DataFrame, days: int = 3, delay: str = "2 days") -> DataFrame:
    """decided_at, symbol, news_id: every decision with the news that blocks it, or with null once none can come any more.

    Both sides are streams: risky news (symbol, known_at, news_id) and
    decisions (symbol, decided_at at the start of a day). News counts from
    ``days`` before the decision to the end of its day. State is kept on both
    sides while the other's watermark allows a match: news for ``days``, a
    decision for its day, both plus the delay. News that comes later than the
    delay blocks nothing.
    """
    n = news.select(F.col("symbol").alias("_symbol"), "known_at", "news_id").withWatermark("known_at", delay)
    d = decisions.select("symbol", "decided_at").withWatermark("decided_at", delay)
    fits = (F.col("known_at") >= F.col("decided_at") - F.expr(f"interval {int(days)} days")) & (F.col("known_at") < F.col("decided_at") + F.expr("interval 1 day"))
    return d.join(n, (F.col("symbol") == F.col("_symbol")) & fits, "leftOuter").select("decided_at", "symbol", "news_id")


def drain(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there into Parquet files and read them back.

    Result and checkpoint lie in the shared folder, so nothing passes through
    the driver. In complete mode each batch replaces the table before it; in
    update mode the rows of every batch stay. A replayed batch writes its own
    files again.
    """
    folder = Folder(stream.sparkSession, "stream").root
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/check").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{folder}/out").start()
    else:
        one = mode == "complete"
        query = writer.foreachBatch(lambda batch, k: batch.write.mode("overwrite").parquet(f"{folder}/out/{0 if one else k}")).start()
    query.awaitTermination()
    # a stream that gave nothing has written nothing
    stream.sparkSession.createDataFrame([], stream.schema).write.mode("append").parquet(f"{folder}/out/none")
    return stream.sparkSession.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/out")


def merge_into(path: str, keys: tuple[str, ...] = ("source", "news_id"), order: tuple[str, ...] = ("fetched_at",)):
    """foreachBatch sink: upsert each batch into a Parquet table by writing version ``v{batch}`` beside the one before.

    Of the rows of one batch that share a key the last by ``order`` counts. A
    replayed batch writes its own version again; a batch whose predecessor is
    missing fails, since the table would start anew without a sign.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        latest = last_wins(batch, list(keys), list(order))
        if batch_id > 0:
            # a missing version raises here
            latest = upsert(spark.read.parquet(f"{path}/v{batch_id - 1}"), latest, keys)
        latest.write.mode("overwrite").parquet(f"{path}/v{batch_id}")

    return write


def failure_breaker(jobs: DataFrame, limit: int = 3) -> DataFrame:
    """Stateful circuit breaker: target, failures, open after ``limit`` failures in a row; a success closes it."""
    import pandas as pd

    def update(key, frames, state):
        streak = state.get[0] if state.exists else 0
        for frame in frames:
            for status in frame.sort_values("created_at")["status"]:
                streak = streak + 1 if status == "failed" else 0
        state.update((streak,))
        yield pd.DataFrame({"target": [key[0]], "failures": [streak], "open": [streak >= limit]})

    return jobs.groupBy("target").applyInPandasWithState(update, "target string, failures long, open boolean", "streak long", "update", "NoTimeout")
