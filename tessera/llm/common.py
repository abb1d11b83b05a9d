"""What the training-data operators share."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import Folder

#: The white space of every contract here: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE_SPACE = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: A table of ids is broadcast up to this many rows (about 30 MB of ids and digests), else joined by shuffle.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows for what is run inside: a bound on a Python worker's memory where rows hold whole texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def give_back() -> None:
    """Hand memory that a task has freed back to the machine: its Python worker lives on, idle, beside the workers and the JVM of later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library keeps what it has


class Scratch:
    """Tables written to the shared folder to cut lineage; each can be dropped once it has been used, the rest go with the application."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = Folder(spark, "tessera").root

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write once, read back: later steps and retried tasks never go behind this table."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep_only(self, *names: str) -> None:
        """Delete every table but these, once nothing will read the others again."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(self.root)
        self.drop(*[s.getPath().getName() for s in folder.getFileSystem(conf).listStatus(folder) if s.getPath().getName() not in names])

    def drop(self, *names: str) -> None:
        """Delete tables that nothing will read again."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file; each operator also takes any other path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(doc_id: Column) -> Column:
    """Rows that no model here learns from: crc32 of the id as text is divisible by 5."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


def crc_held_out(doc_id: int) -> bool:
    """The same rule in Python."""
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, per_class: int) -> list[tuple[int, str, int]]:
    """At most ``per_class`` labelled rows of each class, none of them held out: (doc_id, text, label).

    The sample is the bounded part of the corpus that a model is fitted on.
    Rows are chosen by a hash of their id alone, so the choice is repeatable.
    Rows with a null id, label or text are no samples; of repeated labels the
    largest counts, of repeated documents the longest.
    """
    usable = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where("doc_id is not null and label in (0, 1)")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .withColumn("pick", F.xxhash64("doc_id"))
    )
    chosen = None
    for value in (0, 1):
        part = usable.where(F.col("label") == value).orderBy("pick", "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    # chosen holds at most 2 * per_class short rows
    rows = (
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
        .join(F.broadcast(chosen.select("doc_id", "label")), "doc_id")
        .groupBy("doc_id", "label").agg(F.max_by("text", F.struct(F.length("text"), "text")).alias("text"))
        .collect()
    )
    return sorted((r.doc_id, r.text, r.label) for r in rows)
