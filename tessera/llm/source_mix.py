"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, Scratch

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 2
SHARE = 1.5
#: Sources up to which their table (under 100 bytes a row) is broadcast.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS,
               share: float = SHARE) -> DataFrame:
    """source, source_size -> source, source_size, target.

    Weights repeat over the sources in code point order, null last. A source
    takes at most ``max_epochs`` times its size; what exceeds that is shared
    out again by weight among the others until nobody exceeds. That fixed
    point has a closed form: with the sources in order of cap / weight, the
    first k are clamped, where k is the first place at which the remaining
    budget over the remaining weight gives the next source no more than its
    cap. One row per source is all this reads.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    whole = Window.partitionBy()
    rows = sources.withColumn("weight", weight).withColumns({
        "cap": (F.col("source_size") * max_epochs).cast("double"),
        "budget": F.sum("source_size").over(whole) * F.lit(share),
    })
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumns({
        "clamped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "left": F.sum("weight").over(after),
    })
    level = (F.col("budget") - F.col("clamped")) / F.col("left")
    rows = rows.withColumns({"level": level, "over": F.col("cap") < level * F.col("weight")})
    stop = F.min(F.when(~F.col("over"), F.struct(F.col("clamped").alias("c"), F.col("left").alias("l")))).over(whole)
    rows = rows.withColumn("stop", stop)
    final = F.when(F.col("over") | F.col("stop").isNull(), F.col("cap")).otherwise(
        F.least(F.col("cap"), (F.col("budget") - F.col("stop.c")) * F.col("weight") / F.col("stop.l"))
    )
    return rows.select("source", "source_size", final.alias("target"))


def ticket(doc_id: Column, seed: str) -> Column:
    """Seeded place of a document in its source's order: 15 hex digits of an MD5, as a long."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def mix(documents: DataFrame, scratch: Scratch, seed: str = "mix", weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS,
        share: float = SHARE) -> DataFrame:
    """Every column of ``documents`` and size, source_size, target, copies, taken.

    A document of a source whose target is r times its size is taken
    floor(r) whole times; the fraction is a further whole copy of the documents
    that come first in a seeded order, up to the point at which the source's
    words are nearest its target (off by half of one document at most). Taken
    words never exceed ``max_epochs`` times a document's size.

    Order and cut are found without sorting a source: sizes are added up in
    4096 ticket ranges a source, and only the range in which the cut falls is
    ordered row by row. Null texts have size 0 and take nothing; a null source
    is a source of its own; rows that repeat an id share its place, so a cut
    never splits them; texts of any length count whole; an empty table gives no rows. Reruns agree. Columns of
    the input named like the five new ones are replaced.
    """
    new = ["size", "source_size", "target", "copies", "taken"]
    rows = documents.drop(*new).withColumns({"size": word_count(F.col("text")), "__ticket": ticket(F.col("doc_id"), seed)})
    rows = rows.withColumn("__bucket", F.shiftright("__ticket", 60 - 12))
    ranges = scratch.write(rows.groupBy("source", "__bucket").agg(F.sum("size").alias("words")), "ranges")
    targets = water_fill(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs, share)
    # columns of our own have names that no table of documents bears
    targets = targets.withColumn("__whole", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs))).otherwise(0).cast("long"))
    targets = targets.withColumn("__need", F.greatest(F.col("target") - F.col("__whole") * F.col("source_size"), F.lit(0.0)))
    targets = targets.withColumnRenamed("source", "__of")
    sums = ranges.join(targets, F.col("source").eqNullSafe(F.col("__of"))).drop("__of")
    up_to = Window.partitionBy("source").orderBy("__bucket")
    sums = sums.withColumn("through", F.sum("words").over(up_to))
    # the cut's range is the first whose running sum reaches the need
    cuts = sums.groupBy("source", "source_size", "target", "__whole", "__need").agg(
        F.min(F.when(F.col("through") >= F.col("__need"), F.struct(F.col("__bucket").alias("bucket"), (F.col("through") - F.col("words")).alias("before")))).alias("cut"))
    cuts = cuts.select(F.col("source").alias("__source"), "source_size", "target", "__whole", "__need",
                       F.col("cut.bucket").alias("__cut"), F.col("cut.before").alias("__before"))
    cuts = scratch.write(cuts, "cuts")
    scratch.keep_only("cuts")
    # one row per source: broadcast while there are few sources, else joined by shuffle
    hint = F.broadcast if cuts.count() <= BROADCAST_SOURCES else (lambda df: df)
    dealt = rows.join(hint(cuts), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    at_cut = F.col("__bucket") == F.col("__cut")
    inner = (
        rows.select("source", "doc_id", "size", "__ticket", "__bucket").join(
            hint(cuts.select("__source", "__need", "__cut", "__before")),
            F.col("source").eqNullSafe(F.col("__source")) & (F.col("__bucket") == F.col("__cut")))
        .groupBy("__source", "__need", "__before", "__ticket").agg(F.sum("size").alias("size"))
        .withColumn("through", F.col("__before") + F.sum("size").over(Window.partitionBy("__source").orderBy("__ticket")))
        .groupBy("__source").agg(F.max(F.when(2 * F.col("through") - F.col("size") <= 2 * F.col("__need"), F.col("__ticket"))).alias("__last"))
        .withColumnRenamed("__source", "__inner")
    )
    extra = F.when(F.col("__need") <= 0, False).when(F.col("__cut").isNull(), True).when(at_cut, F.coalesce(F.col("__ticket") <= F.col("__last"), F.lit(False))).otherwise(F.col("__bucket") < F.col("__cut"))
    return (
        dealt.join(hint(inner), F.col("source").eqNullSafe(F.col("__inner")), "left")
        .withColumn("copies", F.least(F.col("__whole") + F.when(extra, 1).otherwise(0), F.lit(max_epochs)).cast("long"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop("__ticket", "__bucket", "__cut", "__before", "__last", "__inner", "__whole", "__need")
    )
