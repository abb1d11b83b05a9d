"""Exact deduplication by a tree merge of sorted digest runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch

#: Runs start in FAN ** ROUNDS slots; each round merges FAN of them, so ROUNDS rounds leave one run a digest range.
FAN, ROUNDS = 4, 2
#: An entry of a run: digest, what verifies it, the best row so far (most code points, then smallest id) and the rows it stands for.
ENTRY = "slot int, part int, digest string, proof string, bytes long, minus_length long, no_id boolean, id long, n long"
_ORDER = ["slot", "part", "digest", "proof", "bytes", "minus_length", "no_id", "id"]
_SAME = ["slot", "part", "digest", "proof", "bytes"]


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    found = F.coalesce(text, F.lit(""))
    for blank in " \n\t\r\x0b\x0c":
        found = F.replace(found, F.lit(blank), F.lit(""))
    return found


def _collapsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Merge the sorted runs of a partition: neighbours of equal digest, proof and length become one entry.

    The first of them is the best one, since the order goes on by length and
    id. Only the last entry is carried from batch to batch.
    """
    held: pd.DataFrame | None = None
    for pdf in batches:
        if not len(pdf):
            continue
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        new = np.ones(len(pdf), bool)
        new[1:] = np.logical_or.reduce([pdf[c].to_numpy()[1:] != pdf[c].to_numpy()[:-1] for c in _SAME])
        first = np.flatnonzero(new)
        out = pdf.iloc[first].assign(n=np.add.reduceat(pdf["n"].to_numpy(), first))
        held = out.iloc[-1:]
        if len(out) > 1:
            yield out.iloc[:-1]
    if held is not None:
        yield held


def digest_groups(documents: DataFrame, fan: int = FAN, rounds: int = ROUNDS) -> DataFrame:
    """One row per distinct normalised text: digest, bytes, no_id, id, n.

    Every input partition sorts its entries and merges equal ones: that is its
    run. Runs are dealt to slots by partition. In each round the slots of one
    group exchange their runs: the exchange deals them by group and digest
    range, every task sorts the run pieces it receives into one sequence and
    merges it. An entry keeps at every level the least (negated length, id),
    which is associative: any order of merging, and any retried task, gives
    the same survivor. Entries are merged only where SHA-256, byte length and
    a second, independent digest agree, so a clash of digests never joins two
    texts. A task holds one batch and one entry, however many copies there
    are; of a text, one entry a partition travels.
    """
    text = normalised(F.col("text"))
    entries = documents.select(
        F.pmod(F.spark_partition_id(), F.lit(fan**rounds)).cast("int").alias("slot"),
        F.sha2(text, 256).alias("digest"),
        F.md5(text).alias("proof"),
        F.octet_length(text).cast("long").alias("bytes"),
        (-F.coalesce(F.length("text"), F.lit(0))).cast("long").alias("minus_length"),
        F.col("doc_id").isNull().alias("no_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"),
        F.lit(1).cast("long").alias("n"),
    ).withColumn("part", F.conv(F.substring("digest", 1, 4), 16, 10).cast("int"))
    names = [c.split()[0] for c in ENTRY.split(", ")]
    runs = entries.select(*names).sortWithinPartitions(*_ORDER).mapInPandas(_collapsed, ENTRY)
    for _ in range(rounds):
        met = runs.withColumn("slot", F.floor(F.col("slot") / fan).cast("int")).repartition("slot", "part")
        runs = met.sortWithinPartitions(*_ORDER).mapInPandas(_collapsed, ENTRY)
    return runs.select("digest", "bytes", "no_id", "id", "n")


def exact_dedup(documents: DataFrame) -> DataFrame:
    """Every column of ``documents`` and keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after white space is deleted; of equal texts
    the row with the most code points, then the smallest id, stays. Null texts
    count as empty; texts of any length count whole. Of rows that repeat one id
    and text every copy counts in group_size and each one bears the same flags;
    ties in length go to the smallest id; a null id ranks last and a row
    without id is never kept beside one that has an id. An empty table gives no
    rows. Columns of the input named like the four new ones are replaced.
    """
    new = ["keep_id", "group_size", "kept", "text_sha256"]
    groups = digest_groups(documents).select(
        F.col("digest").alias("__digest"), F.col("bytes").alias("__bytes"),
        F.when(~F.col("no_id"), F.col("id")).alias("__keep_id"), F.col("n").alias("__n"),
    )
    text = normalised(F.col("text"))
    return (
        documents.drop(*new)
        .withColumns({"__own": F.sha2(text, 256), "__own_bytes": F.octet_length(text).cast("long")})
        .join(groups, (F.col("__own") == F.col("__digest")) & (F.col("__own_bytes") == F.col("__bytes")))
        .withColumns({
            "keep_id": F.col("__keep_id"),
            "group_size": F.col("__n"),
            "kept": F.col("doc_id").eqNullSafe(F.col("__keep_id")),
            "text_sha256": F.col("__own"),
        })
        .drop("__own", "__own_bytes", "__digest", "__bytes", "__keep_id", "__n")
    )


def survivors(documents: DataFrame, scratch: Scratch, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The kept rows with the columns of ``documents``; what is dropped is joined away.

    Only ids and digests are compared. Their table is broadcast while it holds
    at most ``broadcast_rows`` rows and joined by shuffle beyond that. Rows that
    repeat one id and text leave a single row.
    """
    text = normalised(F.col("text"))
    own = documents.withColumn("__own", F.sha2(text, 256))
    best = digest_groups(documents).where("n > 1").select("digest", F.when(~F.col("no_id"), F.col("id")).alias("keep_id"))
    ids = own.select("doc_id", "__own").join(best, F.col("__own") == F.col("digest"))
    copies = ids.groupBy("doc_id", "digest", "keep_id").agg(F.count(F.lit(1)).alias("n"))
    copies = copies.select(
        F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("__kept"), (F.col("n") > 1).alias("__again"),
    ).where("not __kept or __again")
    copies = scratch.write(copies, "copies")
    small = copies.count() <= broadcast_rows
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__digest"))
    hint = F.broadcast if small else (lambda df: df)
    alone = own.join(hint(copies), same, "left_anti")
    again = own.join(hint(copies.where("__kept")), same, "left_semi").dropDuplicates(["doc_id", "__own"])
    return alone.unionByName(again).drop("__own")
