"""Divergence of the sources of each language by integer-dictionary encoding of their kept terms."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .units import array_sweeps

#: A language keeps the terms of so many of its documents at least.
FEWEST_DOCUMENTS = 10
#: Smoothing of a count, the scale of a share, ranks reported of part ``term``.
SMOOTH, SCALE, RANKS = 2, 1_000_000_000, 10
#: Terms of a language in one dense vector, about.
CHUNK = 8192
#: Different terms that a task counts before it hands its counts on.
HELD = 400_000
#: Bytes to bytes: letters in lower case, all other ASCII to the space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
RESULT = "lang string, source string, part string, item string, value long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of every (lang, source, term) of a task, handed on in parts."""
    held: dict[tuple, list[Counter]] = {}

    def rows() -> pa.RecordBatch:
        lang, source, term, n, docs = [], [], [], [], []
        for (one, other), (times, within) in held.items():
            lang += [one] * len(times)
            source += [other] * len(times)
            term += [t.decode("utf-8") for t in times]
            n += times.values()
            docs += [within[t] for t in times]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((lang, source, term, n, docs), _COUNTED, strict=True)], schema=_COUNTED)

    for batch in batches:
        langs, sources, at = batch.column("lang").to_pylist(), batch.column("source").to_pylist(), 0
        for sweep in array_sweeps(batch.column("text")):
            for text in sweep:
                terms = text.encode("utf-8").translate(_LETTERS).split()
                times, within = held.setdefault((langs[at], sources[at]), [Counter(), Counter()])
                times.update(terms)
                within.update(set(terms))
                at += 1
            if sum(len(times) for times, _ in held.values()) > HELD:
                yield rows()
                held.clear()
    if held:
        yield rows()


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * counts / total) without overflow: long division by three digits of 1,000 each."""
    whole, rest = np.divmod(counts, total)
    out = whole
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); both are at most SCALE + 1, so the square fits."""
    return (p - q) ** 2 // (p + q)


def _chunk(counts: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """One chunk of a language's terms against all its groups: summed distances of each pair, best terms of each group."""
    if counts.empty or groups.empty:
        return pd.DataFrame(columns=["lang", "source", "part", "item", "value"])
    lang = groups["lang"].iloc[0]
    groups = groups.sort_values("source", kind="stable", key=lambda s: s.map(lambda x: x.encode()))
    # term and source numbers are places in sorted arrays of UTF-8 bytes, so their order is the order of the bytes
    coded = np.array([t.encode() for t in counts["term"]], dtype=object)
    terms = np.array(sorted(set(coded.tolist())), dtype=object)
    names = np.array([s.encode() for s in groups["source"]], dtype=object)
    term, source = np.searchsorted(terms, coded), np.searchsorted(names, np.array([s.encode() for s in counts["source"]], dtype=object))
    # one dense row a group; counts are summed as whole numbers, not as weights in doubles
    size = len(names) * len(terms)
    place = source * len(terms) + term
    dense = np.zeros(size, np.int64)
    n = counts["n"].to_numpy(np.int64)
    # bincount gives the rows of each place; a repeated place (none is left after the shuffle) would be added up
    if np.bincount(place, minlength=size).max() == 1:
        dense[place] = n
    else:
        np.add.at(dense, place, n)
    dense = dense.reshape(len(names), len(terms))
    kept = int(groups["kept"].iloc[0])
    total = groups["total"].to_numpy(np.int64) + SMOOTH * kept
    p = shares(dense + SMOOTH, total[:, None])
    whole = shares(dense.sum(axis=0) + SMOOTH, np.int64(groups["total"].sum() + SMOOTH * kept))
    out = []
    for k in range(len(names)):
        sums = distances(p[k + 1 :], p[k]).sum(axis=1)
        for j, value in enumerate(sums.tolist(), k + 1):
            out += [(names[k], "pair", names[j], value), (names[j], "pair", names[k], value)]
        more = np.flatnonzero((dense[k] > 0) & (p[k] > whole))
        value = distances(p[k][more], whole[more])
        best = np.lexsort((more, -value))[:RANKS]
        out += [(names[k], "term", terms[more[b]], int(value[b])) for b in best]
    return pd.DataFrame([(lang, a.decode(), part, b.decode(), v) for a, part, b, v in out], columns=["lang", "source", "part", "item", "value"])


def audit(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """lang, source, part, item, value, rank: how far the sources of a language lie apart, and by which terms.

    Needs the columns text, lang and source; others are left alone, whatever
    their names. Terms are stretches of letters and of all that is not ASCII,
    A-Z in lower case. A language keeps the terms of FEWEST_DOCUMENTS documents
    or more. Part ``pair`` holds every other source of the language, part
    ``term`` the first RANKS of the terms in which the group exceeds its
    language; ranks go by value, then by the item's UTF-8 bytes.

    Null text, lang and source are the empty string. A group without terms has
    its pairs; a language that keeps no term has pairs of value 0; a language
    of one source has no pairs. Repeated rows count as often as they occur.
    Very long texts are read whole. An empty table gives no rows.

    Counts are summed within tasks before their one shuffle. Kept terms are
    dealt by ranges of (lang, term), so a chunk of a hot language or a frequent
    term is no larger than another; no list of terms is held whole anywhere.
    """
    spark = documents.sparkSession
    plain = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    counted = plain.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    summed = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    spread = summed.withColumn("docs", F.sum("docs").over(Window.partitionBy("lang", "term")))
    kept = scratch.write(spread.where(F.col("docs") >= FEWEST_DOCUMENTS).select("lang", "source", "term", "n"), "kept")
    # groups and languages are as few as the pairs of the result allow; terms are never among them
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    words = kept.groupBy("lang", "term").agg(F.lit(1).alias("one")).groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    groups = scratch.write(
        plain.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(words, "lang", "left").fillna(0, ["total", "kept"]), "groups")
    parts = max(1, -(-(words.agg(F.sum("kept")).first()[0] or 0) // CHUNK))
    chunks = scratch.write(kept.repartitionByRange(int(parts), "lang", "term").withColumn("chunk", F.spark_partition_id()), "chunks")
    asked = groups.join(chunks.select(F.col("lang").alias("of"), F.col("chunk").alias("part")).distinct(), F.col("lang") == F.col("of"))
    found = chunks.groupBy("lang", "chunk").cogroup(asked.groupBy("of", "part")).applyInPandas(_chunk, RESULT)
    found = scratch.write(found, "found")
    other = groups.select("lang", F.col("source").alias("item"))
    none = groups.where("kept = 0").select("lang", "source").join(other, "lang").where("source <> item")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.unionByName(none.select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value")))
    scratch.drop("kept", "chunks")
    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    # a limit on the rank is kept before the shuffle, so only the best terms of each task meet
    terms = found.where("part = 'term'").withColumn("rank", place).where(F.col("rank") <= RANKS)
    return pairs.withColumn("rank", place).unionByName(terms)
