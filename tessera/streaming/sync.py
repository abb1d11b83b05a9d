"""Resumable syncs: what each target's jobs have led to, remembered across batches and restarts."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Failures in a row that open a target's breaker, days until it closes by itself, requests that a target may have in a window of as many days.
MOST_FAILURES, COOL_DAYS, QUOTA, QUOTA_DAYS = 3, 30, 4, 90
DECISION = "target string, job_id long, at timestamp, decision string, streak int"
_DAY_MS = 86_400_000


class Breaker(StatefulProcessor):
    """One target's memory: failures in a row, until when its breaker is open, and the times of its last requests.

    A job is skipped while the breaker is open or the window's quota is spent;
    else it runs: a failure adds to the streak, and the ``MOST_FAILURES``-th
    opens the breaker; any other outcome sets the streak back. An event-time
    timer closes the breaker and tells so once the watermark has passed its
    end; a job that comes earlier but lies after the end in event time finds it
    closed all the same, so the decisions do not depend on how rows are dealt
    to batches.
    """

    def __init__(self, most: int = MOST_FAILURES, cool_days: int = COOL_DAYS, quota: int = QUOTA, quota_days: int = QUOTA_DAYS):
        self.most, self.cool, self.quota, self.window = most, cool_days * _DAY_MS, quota, quota_days * _DAY_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.memory = handle.getValueState("memory", "streak int, open_until long")
        self.recent = handle.getListState("recent", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        streak, until = self.memory.get() or (0, 0)
        recent = [r[0] for r in self.recent.get()]
        made, known = [], until
        # a batch's rows of one target are its new requests: their number is bounded by the batch
        jobs = pd.concat(list(rows)).sort_values(["created_at", "job_id"], kind="stable")
        for job in jobs.itertuples(index=False):
            now = int(job.created_at.timestamp() * 1000)
            if until and now >= until:
                streak, until = 0, 0
            recent = [t for t in recent if t > now - self.window]
            if until:
                decision = "open"
            elif len(recent) >= self.quota:
                decision = "quota"
            else:
                recent.append(now)
                decision = "run"
                streak = streak + 1 if job.status == "failed" else 0
                if streak >= self.most:
                    until, decision = now + self.cool, "tripped"
            made.append((key[0], job.job_id, job.created_at, decision, streak))
        if until != known:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if until:
                self.handle.registerTimer(until)
        self.memory.update((streak, until))
        self.recent.put([(t,) for t in recent])
        yield pd.DataFrame(made, columns=["target", "job_id", "at", "decision", "streak"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = expiredTimerInfo.getExpiryTimeInMs()
        streak, until = self.memory.get() or (0, 0)
        if until and until <= end:
            self.memory.update((0, 0))
            yield pd.DataFrame({"target": [key[0]], "job_id": [None], "at": [pd.Timestamp(end, unit="ms")], "decision": ["closed"], "streak": [0]})

    def close(self) -> None:
        pass


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The state store that timers and lists need, for streams that are started inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def decisions(jobs: DataFrame, breaker: Breaker | None = None, delay: str = "1 day") -> DataFrame:
    """What is done about each job (target, job_id, created_at, status) of a stream: run, tripped, open or quota; and closed once a breaker's time is over."""
    stream = jobs.select("target", "job_id", F.col("created_at").cast("timestamp").alias("created_at"), "status").withWatermark("created_at", delay)
    return stream.groupBy("target").transformWithStateInPandas(breaker or Breaker(), DECISION, "append", "eventTime")
