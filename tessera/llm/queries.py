"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    exact_dedup, page_wrapper, periodic_runs, piece_codec, pii_surrogates, pivot_search, quality_net, secret_markov, shingle_join, source_audit, source_mix,
    token_transducer, toxic_crf,
)
from .common import Scratch, held_out, labelled_sample, table, tokenizer_file

#: Most labelled rows of each class that a model is fitted on.
TOXIC_SAMPLE, QUALITY_SAMPLE = 1700, 3000


def op1_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best inner products of every 50th vector."""
    return pivot_search.search(table(spark, sf_dir, "embeddings"), Scratch(spark))


def op2_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return shingle_join.near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark))


def op3_secret_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents."""
    ratios = secret_markov.fit(secret_markov.training_samples(spark))
    found = secret_markov.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), ratios)
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda s: s["kind"] < 3)
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secret_markov.joined(base), 256).alias("base_sha256"), secret_markov.joined(F.col("secrets")).alias("spans"),
    )


def op4_pii_surrogates(spark: SparkSession, sf_dir: str, key: str = "surrogates-1") -> DataFrame:
    """All documents with their personal data replaced."""
    found = pii_surrogates.replace(table(spark, sf_dir, "documents").select("doc_id", "text"), key, Scratch(spark))
    return found.select("doc_id", "n_entities", "text")


def op5_toxic_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents; spans are further columns."""
    documents = table(spark, sf_dir, "documents")
    crf = toxic_crf.fit(labelled_sample(documents, table(spark, sf_dir, "labels"), "toxic", TOXIC_SAMPLE))
    tagged = documents.select("doc_id", toxic_crf.score_column(crf, F.col("text")).alias("t"))
    return tagged.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("t.score").alias("score"),
        (F.col("t.score") >= 0.5).cast("int").alias("predicted"), F.col("t.spans").alias("spans"),
    )


def op6_piece_codec(spark: SparkSession, sf_dir: str, model_file: str | None = None) -> DataFrame:
    """Ids and round trip of all documents."""
    coded = table(spark, sf_dir, "documents").select(
        "doc_id", piece_codec.digest_column(F.col("text"), model_file or tokenizer_file("piece_bpe_32k.model")).alias("c"))
    return coded.select("doc_id", "c.n_tokens", "c.ids_sha256", "c.decoded_sha256")


def op7_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    documents = table(spark, sf_dir, "documents")
    net = quality_net.fit(labelled_sample(documents, table(spark, sf_dir, "labels"), "quality", QUALITY_SAMPLE))
    scored = documents.select("doc_id", quality_net.score_column(net, F.col("text")).alias("score"))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= quality_net.KEEP_FROM).cast("int").alias("predicted"),
    )


def op8_token_transducer(spark: SparkSession, sf_dir: str, json_file: str | None = None, limit: int = 1024) -> DataFrame:
    """Token counts of all documents."""
    counted = table(spark, sf_dir, "documents").select(
        "doc_id", F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("n_bytes"),
        token_transducer.count_column(F.col("text"), json_file or tokenizer_file("byte_bpe_50k.json")).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents to their sources' targets."""
    mixed = source_mix.mix(table(spark, sf_dir, "documents"), Scratch(spark))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates of all documents."""
    found = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words of all documents, some of them with a planted tail."""
    found = table(spark, sf_dir, "documents").select(
        "doc_id", periodic_runs.run_column(F.col("text"), F.crc32(F.col("doc_id").cast("string"))).alias("r"))
    lines = F.transform("r.runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    best = F.col("r.strongest")
    return found.select(
        "doc_id", F.size("r.runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("1000 * r.strongest.length div r.strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("r.collapsed", 256).alias("collapsed_sha256"),
    )


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language lie apart, over all documents."""
    return source_audit.audit(table(spark, sf_dir, "documents"), Scratch(spark)).select("lang", "source", "part", "item", "value", "rank")


def op13_page_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    found = page_wrapper.extract(table(spark, sf_dir, "pages"), Scratch(spark))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def queries() -> dict:
    """Query name to ``(spark, sf_dir) -> DataFrame``."""
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


_OP1 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_OP2 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM w
), n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, list_sort(s) AS s FROM s),
c AS (SELECT s, min(doc_id) AS rep, any_value(n_shingles) AS n FROM n WHERE n_shingles > 0 GROUP BY s),
u AS (SELECT rep, n, unnest(s) AS x FROM c),
p AS (
  SELECT a.rep AS a, b.rep AS b FROM u a JOIN u b ON a.x = b.x AND a.rep < b.rep AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 180 * count(*) >= 80 * (a.n + b.n)
), e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT rep AS a, rep AS root FROM c UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.a),
m AS (SELECT a, min(root) AS root FROM r GROUP BY a)
SELECT n.doc_id, n.n_shingles, coalesce(m.root, n.doc_id) AS component_id
FROM n LEFT JOIN c ON n.s = c.s AND n.n_shingles > 0 LEFT JOIN m ON m.a = c.rep
"""

_OP9 = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS ticket
  FROM documents
), src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT *, ([5.0, 2.0, 1.0])[1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3]::DOUBLE AS weight FROM src
), capped AS (
  SELECT *, (source_size * 2)::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5 AS budget FROM weighted
), filled AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS clamped,
         sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM capped
), stopped AS (
  SELECT *, cap < (budget - clamped) / rest * weight AS above FROM filled
), level AS (
  SELECT min(clamped) AS c, max(rest) AS l FROM stopped WHERE NOT above
), targets AS (
  SELECT source, source_size, CASE WHEN above OR l IS NULL THEN cap ELSE least(cap, (budget - c) * weight / l) END AS target
  FROM stopped, level
), needs AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2)::BIGINT ELSE 0 END AS whole FROM targets
), runs AS (
  SELECT s.doc_id, s.size, s.ticket, n.source_size, n.target, n.whole, s.source,
         greatest(n.target - n.whole * n.source_size, 0) AS need,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.ticket) AS through,
         sum(s.size) OVER (PARTITION BY s.source, s.ticket) AS tied
  FROM sized s JOIN needs n ON s.source IS NOT DISTINCT FROM n.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * least(whole + CASE WHEN need > 0 AND 2 * through - tied <= 2 * need THEN 1 ELSE 0 END, 2) AS BIGINT) AS taken
FROM runs
"""

_OP10 = r"""
WITH t AS (
  SELECT doc_id, coalesce(length(text), 0) AS n_points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id IS NULL, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM g
"""

_OP12 = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), tok AS (
  SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term FROM tok GROUP BY lang, term HAVING count(DISTINCT id) >= 10
), counted AS (
  SELECT t.lang, t.source, t.term, count(*) AS n FROM tok t JOIN kept k ON t.lang = k.lang AND t.term = k.term GROUP BY t.lang, t.source, t.term
), v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
grp AS (
  SELECT g.lang, g.source, coalesce(any_value(v.v), 0) AS v, coalesce(sum(c.n), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN v ON v.lang = g.lang LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source
), share AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2)) // (g.total + 2 * g.v) AS p
  FROM grp g JOIN kept k ON k.lang = g.lang LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), whole AS (
  SELECT t.lang, t.term, 1 + (CAST(1000000000 AS HUGEINT) * (t.n + 2)) // (l.total + 2 * l.v) AS p
  FROM (SELECT lang, term, sum(n) AS n FROM counted GROUP BY lang, term) t JOIN (SELECT lang, sum(total) AS total, any_value(v) AS v FROM grp GROUP BY lang) l ON l.lang = t.lang
), apart AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM share a JOIN share b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), pairs AS (
  SELECT g.lang, g.source, 'pair' AS part, o.source AS item, coalesce(a.value, 0) AS value
  FROM grp g JOIN grp o ON o.lang = g.lang AND o.source <> g.source LEFT JOIN apart a ON a.lang = g.lang AND a.source = g.source AND a.item = o.source
), terms AS (
  SELECT s.lang, s.source, 'term' AS part, s.term AS item, (s.p - w.p) * (s.p - w.p) // (s.p + w.p) AS value
  FROM share s JOIN whole w ON w.lang = s.lang AND w.term = s.term WHERE s.n > 0 AND s.p > w.p
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    return {"op1_pivot_search": _OP1, "op2_shingle_join": _OP2, "op9_source_mix": _OP9, "op10_exact_dedup": _OP10, "op12_source_audit": _OP12}
