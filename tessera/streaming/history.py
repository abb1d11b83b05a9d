"""Slowly changing dimensions as a stream: snapshots close and open intervals, each exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.manifest import Manifest

#: Ranges of scopes in which the history is kept; a batch rewrites only those that it meets.
RANGES = 16
HISTORY = "scope string, key string, value string, valid_from date, valid_to date"


def range_of(scope, ranges: int = RANGES):
    """The range that a scope's history lies in."""
    return F.pmod(F.xxhash64(scope), F.lit(ranges)).cast("int")


def evolved(history: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The history after some snapshots, in order of their dates.

    A snapshot (scope, as_of, key, value) states all keys of its scope at its
    date. A key that is new or has a new value opens an interval there; one
    that changed or vanished ends there; an interval of no length is not kept.
    Equal snapshots change nothing. A null key marks a snapshot without keys;
    of rows that state one key twice the larger value counts. Snapshots older
    than the latest of their scope are not taken; ``late`` gives them.

    Stretches of equal values in neighbouring snapshots are found per key in
    one ordering; no key is looked up in snapshots that lack it.
    """
    taken = on_time(history, snapshots)
    date = Window.partitionBy("scope").orderBy("as_of")
    dates = taken.select("scope", "as_of").distinct().select("scope", "as_of", F.row_number().over(date).cast("long").alias("place"))
    stated = taken.where("key is not null").groupBy("scope", "as_of", "key").agg(F.max("value").alias("value")).join(dates, ["scope", "as_of"])
    met = dates.select("scope").distinct()
    own = history.where("key is not null")
    open_ = own.where("valid_to is null").join(met, "scope", "left_semi").select("scope", F.col("valid_from").alias("as_of"), "key", "value", F.lit(0).cast("long").alias("place"))
    series = stated.select("scope", "as_of", "key", "value", "place").unionByName(open_)
    w = Window.partitionBy("scope", "key").orderBy("place")
    fresh = F.coalesce((F.lag("place").over(w) != F.col("place") - 1) | ~F.lag("value").over(w).eqNullSafe(F.col("value")), F.lit(True))
    stretches = series.withColumn("fresh", fresh).withColumn("stretch", F.count_if("fresh").over(w)).groupBy("scope", "key", "stretch").agg(
        F.min("as_of").alias("valid_from"), F.max_by("value", "place").alias("value"), (F.max("place") + 1).alias("place"))
    ends = stretches.join(dates.select("scope", "place", F.col("as_of").alias("valid_to")), ["scope", "place"], "left")
    made = ends.where("valid_to is null or valid_to > valid_from").select("scope", "key", "value", "valid_from", "valid_to")
    # the open rows of the scopes met were carried on above; all others stay as they are
    stays = own.where("valid_to is not null").unionByName(own.where("valid_to is null").join(met, "scope", "left_anti"))
    seen = history.where("key is null").select("scope", "valid_from").unionByName(taken.select("scope", F.col("as_of").alias("valid_from")))
    marks = seen.groupBy("scope").agg(F.max("valid_from").alias("valid_from")).select("scope", F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value"), "valid_from", F.lit(None).cast("date").alias("valid_to"))
    return stays.unionByName(made).unionByName(marks)


def _latest(history: DataFrame) -> DataFrame:
    """Date of the latest snapshot of each scope: the rows without a key."""
    return history.where("key is null").groupBy("scope").agg(F.max("valid_from").alias("_seen"))


def on_time(history: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Snapshots not older than the latest one of their scope."""
    return snapshots.join(_latest(history), "scope", "left").where("_seen is null or as_of >= _seen").drop("_seen")


def late(history: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Snapshots that came after a newer one of their scope."""
    return snapshots.join(_latest(history), "scope").where("as_of < _seen").drop("_seen")


class History:
    """The history in files by range of scopes, whose versions a manifest names by micro-batch.

    A batch reads the ranges that it meets, writes each anew under its own
    number and commits at the end. A batch that is replayed after its commit
    changes nothing; one that failed before it is written again from the state
    before. Files that the last two commits do not name are deleted.
    """

    def __init__(self, spark: SparkSession, path: str, ranges: int = RANGES):
        self.spark, self.path, self.ranges = spark, path.rstrip("/"), ranges
        self.manifest = Manifest(spark, path)

    def _parts(self, content: dict, only: list[int] | None = None) -> DataFrame:
        files = [f"{self.path}/{part}" for r, part in sorted(content.get("ranges", {}).items()) if only is None or int(r) in only]
        return self.spark.read.schema(HISTORY).parquet(*files) if files else self.spark.createDataFrame([], HISTORY)

    def table(self) -> DataFrame:
        """All intervals of the present state."""
        return self._parts(self.manifest.read()[1]).where("key is not null")

    def late(self) -> DataFrame:
        """Snapshots that came too late, of all batches."""
        files = [f"{self.path}/{part}" for part in self.manifest.read()[1].get("late", [])]
        schema = "scope string, as_of date, key string, value string"
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """foreachBatch sink for snapshots (scope, as_of, key, value)."""
        version, content = self.manifest.read()
        if content.get("batch", -1) >= batch_id:
            return
        rows = batch.select("scope", F.col("as_of").cast("date").alias("as_of"), F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))
        rows = rows.withColumn("range", range_of(F.col("scope"), self.ranges)).persist()
        try:
            # one number for each range, of which there are as many as the table was made with
            met = sorted(r.range for r in rows.select("range").distinct().collect())
            before = self._parts(content, met)
            plain = rows.drop("range")
            after = evolved(before, plain).withColumn("range", range_of(F.col("scope"), self.ranges))
            folder = f"batch{batch_id:09d}"
            after.repartition("range").write.mode("overwrite").partitionBy("range").parquet(f"{self.path}/{folder}/history")
            late(before, plain).write.mode("overwrite").parquet(f"{self.path}/{folder}/late")
        finally:
            rows.unpersist()
        old = content.get("ranges", {})
        named = {**old, **{str(r): f"{folder}/history/range={r}" for r in met}}
        self.manifest.commit(version, {"batch": batch_id, "ranges": named, "late": [*content.get("late", []), f"{folder}/late"], "unused": sorted(set(old.values()) - set(named.values()))})
        # what the commit before this one gave up has no reader any more
        for part in content.get("unused", []):
            self.manifest.drop(part)
