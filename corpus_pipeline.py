"""A corpus pipeline of five stages over ``documents``: quality, exact copies, near copies, source mix, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, piece_codec, quality_net, shingle_join, source_mix
from tessera.llm.common import Scratch, labelled_sample, table, tokenizer_file

QUALITY_SAMPLE = 3000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network accepts. The network learns from labelled rows of ``docs``; null texts score as empty ones.

    Every text is read whole; repeated rows share one fate; further columns pass through; an empty table gives no rows.
    """
    net = quality_net.fit(labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", QUALITY_SAMPLE))
    scored = docs.withColumn("__score", quality_net.score_column(net, F.col("text")))
    return scored.where(F.col("__score") >= quality_net.KEEP_FROM).drop("__score")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of texts that are equal without white space: that with the longest original, then the smallest id.

    Null texts count as empty and are equal to each other; rows that repeat one id and text leave a single row; further
    columns pass through; an empty table gives no rows.
    """
    return exact_dedup.survivors(docs, Scratch(spark))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate component.

    Null and wordless texts are linked with nothing and stay, as do rows without an id; texts are compared whole; further
    columns pass through; an empty table gives no rows.
    """
    return shingle_join.one_of_each(docs, Scratch(spark))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its source's target asks, from not at all to twice.

    Null and wordless texts have size 0 and are not taken; a null source is a source of its own; the choice is seeded, so
    reruns agree; further columns pass through; an empty table gives no rows.
    """
    mixed = source_mix.mix(docs, Scratch(spark)).where("copies > 0")
    repeated = mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, the token ids with the end id, their number, and the digests of the ids and of the text that they decode to, for every row of the mix."""
    coded = docs.select("doc_id", "source", piece_codec.coded_column(F.col("text"), tokenizer_file("piece_bpe_32k.model")).alias("c"))
    return coded.select("doc_id", "source", "c.ids", "c.n_tokens", "c.ids_sha256", "c.decoded_sha256")


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("source mix", mix),
    ("SentencePiece codec", encode),
]

#: SQL can express neither the network nor the codec; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn over all its predecessor kept, each written and read again."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(f"stage{k - 1}")
    return docs
