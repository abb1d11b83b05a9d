"""Secret scanning: base patterns and character Markov models, in DataFrame functions alone."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The base patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: What the Markov models judge: runs of key characters of at least 20 that hold a digit.
RUN = r"(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
KINDS = ("assign", "access", "hex", "markov")
#: Labelled samples of each class that the models are fitted on.
SAMPLES = 4000

Span = "array<struct<start:int,kind:int,end:int>>"


def _spans(text: Column, pattern: str, kind: int, keep) -> Column:
    """Spans of a pattern's leftmost non-overlapping matches; ``keep`` judges a matched string.

    Text between matches comes from split, the matches from extract_all; adding
    up their lengths (in code points) gives every start. Texts without a match
    pay for one search only.
    """
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("hit"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(Span).alias("spans"))

    def step(acc, x):
        begin = acc["at"] + x["gap"]
        end = begin + F.length(x["hit"])
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(keep(x["hit"]), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.when(F.coalesce(text.rlike(pattern), F.lit(False)), F.aggregate(steps, start, step, lambda acc: acc["spans"])).otherwise(F.array().cast(Span))


def training_samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """Labelled strings (value, random): n random keys and n ordinary identifiers, made by a seeded rule.

    Random ones are digests in hexadecimal, Base64 and mixed capitals.
    Ordinary ones are identifiers that programs and texts hold: syllables
    joined into snake, camel and kebab words with version numbers and dates.
    """
    ids = spark.range(n)
    digest = lambda salt: F.sha2(F.concat(F.lit(salt), F.col("id")), 256)
    encoded = F.translate(F.base64(F.unhex(digest("b"))), "=", "")
    keys = ids.select(
        F.when(F.col("id") % 3 == 0, F.substring(digest("a"), 1, 40))
        .when(F.col("id") % 3 == 1, F.substring(encoded, 1, 36))
        .otherwise(F.upper(F.substring(F.regexp_replace(encoded, "[^A-Za-z0-9]", "7"), 1, 24))).alias("value"),
        F.lit(True).alias("random"))
    onset = F.array(*map(F.lit, "b c d f g h l m n p r s t v w st tr ch th pr".split()))
    vowel = F.array(*map(F.lit, "a e i o u ea ou io er in on an".split()))
    pick = lambda salt, of, size: F.element_at(of, (F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(size)) + 1).cast("int"))
    word = lambda k: F.concat(*[pick(f"{k}{j}{part}", of, size) for j in range(3) for part, of, size in (("o", onset, 20), ("v", vowel, 12))])
    number = F.pmod(F.xxhash64(F.lit("n"), "id"), F.lit(1000)).cast("string")
    plain = ids.select(
        F.when(F.col("id") % 4 == 0, F.concat_ws("_", word("a"), word("b"), word("c"), number))
        .when(F.col("id") % 4 == 1, F.concat(word("a"), F.initcap(word("b")), F.initcap(word("c")), number))
        .when(F.col("id") % 4 == 2, F.concat_ws("-", word("a"), F.concat(F.lit("2024-0"), F.substring(number, 1, 1)), word("b"), number))
        .otherwise(F.concat(F.upper(F.concat_ws("_", word("a"), word("b"))), F.lit("_"), number)).alias("value"),
        F.lit(False).alias("random"))
    return keys.unionByName(plain)


def fit(samples: DataFrame, smoothing: float = 0.5) -> list[float]:
    """Log-likelihood ratio of every character pair, random against ordinary, row by row of the alphabet.

    The counts of both first-order models are grouped in Spark; the table that
    comes back has as many cells as the alphabet squared, whatever the samples.
    """
    size = len(ALPHABET)
    pairs = samples.select("random", F.explode(F.expr("transform(sequence(1, length(value) - 1), i -> substring(value, i, 2))")).alias("pair"))
    counts = {(r.random, r.pair): r.n for r in pairs.groupBy("random", "pair").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = []
    for a in ALPHABET:
        sums = {y: sum(counts.get((y, a + b), 0) for b in ALPHABET) for y in (True, False)}
        logs = {y: [math.log((counts.get((y, a + b), 0) + smoothing) / (sums[y] + smoothing * size)) for b in ALPHABET] for y in (True, False)}
        table += [round(p - q, 4) for p, q in zip(logs[True], logs[False], strict=True)]
    return table


def _ratio(value: Column, table: list[float]) -> Column:
    """Log-likelihood ratio of a string: the sum over its character pairs."""
    cells = F.from_json(F.lit(json.dumps(table)), "array<double>")
    codes = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    pairs = F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1),
                       lambda a, b: F.get(cells, (a - 1) * len(ALPHABET) + b - 1))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def scan(documents: DataFrame, table: list[float], cut: float = 1.0) -> DataFrame:
    """Every column of ``documents`` and ``secrets``: array<struct<start, kind, end>> by start, then kind.

    Base matches come first and stay: assignments whose value has 8 or more
    characters, access keys of 16 or more, hexadecimal runs of 32 or more. Runs
    of key characters that touch no base span are added as ``markov`` where
    their log-likelihood ratio exceeds ``cut`` a character pair. Offsets count
    code points, the end is exclusive. Null and empty texts hold no secrets; texts of
    any length are read whole; spans that start together go by kind; repeated
    rows give repeated results; an empty table gives no rows; a column named ``secrets`` is replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.concat(
        _spans(text, ASSIGN, 0, lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 2)) >= 8),
        _spans(text, ACCESS, 1, lambda hit: F.length(hit) >= 16),
        _spans(text, HEX.replace("+", "{32,}"), 2, lambda hit: F.length(hit) >= 32),
    )
    added = _spans(text, RUN, 3, lambda hit: _ratio(hit, table) > cut * (F.length(hit) - 1))
    rows = documents.withColumns({"__base": base, "__added": added})
    apart = F.filter("__added", lambda x: ~F.exists("__base", lambda b: (x["start"] < b["end"]) & (b["start"] < x["end"])))
    return rows.withColumn("secrets", F.array_sort(F.concat("__base", apart))).drop("__base", "__added")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
