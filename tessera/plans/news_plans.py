"""News queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import news as N
from tessera.sources.tables import SQL_NEWS, load, news

TYPES = ("click", "purchase")
PHRASES = [w for _, _, words in N.KEYWORDS.values() for w in words] + ["公告", "年报", "ordinary news"]


def _stories(spark, sf_dir):
    """Documents as news: a phrase by id is the title, some ids have a second one in the body."""
    d = load(spark, sf_dir, "documents").select("doc_id", "text")
    phrases = F.array(*map(F.lit, PHRASES))
    pick = lambda k: F.element_at(phrases, (F.pmod(k, F.lit(len(PHRASES))) + 1).cast("int"))
    extra = F.when(F.col("doc_id") % 3 == 0, pick(F.col("doc_id") * 7)).otherwise("")
    return d.select("doc_id", pick(F.col("doc_id")).alias("title"), F.concat(F.coalesce("text", F.lit("")), extra).alias("body"))


def _decisions(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return e.select(F.to_date("ts").alias("decision_date")).distinct()


def news_scan(spark, sf_dir):
    """Newest items of one source known in a window."""
    return N.scan(news(spark, sf_dir), source="feed1", known_start="2024-01-05", known_end="2024-01-20", limit=200).select("news_id", "symbol", "event_type", "published_at", "fetched_at")


def news_known_counts(spark, sf_dir):
    """Items by day of knowledge, in both modes."""
    n = news(spark, sf_dir).drop("known_at")
    parts = [N.known(n, m).select(F.lit(m).alias("mode"), F.to_date("known_at").alias("day")) for m in ("observed", "published_at")]
    return parts[0].unionByName(parts[1]).groupBy("mode", "day").agg(F.count(F.lit(1)).alias("n"))


def news_classify(spark, sf_dir):
    """Stories by keyword class."""
    c = _stories(spark, sf_dir).select("doc_id", N.classify(F.col("title"), F.col("body")).alias("c"))
    return c.select("doc_id", "c.event_type", "c.label", "c.score")


def news_reclassify(spark, sf_dir):
    """Stored stories that the present keywords change."""
    k = F.col("doc_id")
    old = _stories(spark, sf_dir).withColumns({
        "event_type": F.when(k % 2 == 0, "neutral").otherwise("company_risk"), "sentiment_label": F.when(k % 2 == 0, "").otherwise("risk"),
        "sentiment_score": F.when(k % 2 == 1, F.lit(-0.4))})
    return N.reclassified(old).select("doc_id", "event_type", "sentiment_label", "sentiment_score")


def news_class_counts(spark, sf_dir):
    """Documents per class."""
    return news_classify(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def _classed(spark, sf_dir):
    """The news with a phrase by id as title, classed by keywords, and a relevance by id."""
    k = F.col("news_id")
    title = F.element_at(F.array(*map(F.lit, PHRASES)), (F.pmod(k * 11, F.lit(len(PHRASES))) + 1).cast("int"))
    n = news(spark, sf_dir).drop("event_type", "sentiment_score").withColumn("c", N.classify(title, F.lit("")))
    return n.select("news_id", "symbol", "known_at", "c.event_type", F.col("c.label").alias("sentiment_label"), F.col("c.score").alias("sentiment_score"), (F.when(k % 7 != 0, k % 10) / 10.0).alias("relevance_score"))


def news_block_list(spark, sf_dir):
    """Blocked symbols by decision date, with the defaults: severe items of the last three days."""
    return N.block_list(_classed(spark, sf_dir), _decisions(spark, sf_dir))


def news_block_list_by_score(spark, sf_dir):
    """The same by label or score, from a relevance on."""
    return N.block_list(_classed(spark, sf_dir), _decisions(spark, sf_dir), 5, (), 0.3, -0.4)


def news_risk_summary(spark, sf_dir):
    """Risk per symbol."""
    return N.risk_summary(news(spark, sf_dir), TYPES)


def news_coverage(spark, sf_dir):
    """Coverage per symbol."""
    return N.coverage(news(spark, sf_dir))


def news_upsert(spark, sf_dir):
    """A second delivery merged into the store."""
    n = news(spark, sf_dir).select("source", "news_id", "symbol", "event_type", "sentiment_score", "published_at", "fetched_at")
    old = n.where("news_id % 3 <> 0")
    new = n.where("news_id % 2 = 0").withColumns({"sentiment_score": F.round(F.col("sentiment_score") + 1, 6), "fetched_at": F.expr("fetched_at + interval 1 day")})
    return N.upsert(old, new)


def news_evidence(spark, sf_dir):
    """Three most urgent items of each symbol."""
    return N.evidence(news(spark, sf_dir), TYPES, 3).select("symbol", "news_id", "event_type", F.col("place").cast("long").alias("place"))


def news_text_repair(spark, sf_dir):
    """Every document, a third of them read in a wrong code, cleaned: id, digest of the text, marks of damage before and after."""
    k, text = F.col("doc_id"), F.col("text")
    damaged = F.when(k % 3 == 0, F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")).when(k % 3 == 1, F.concat(F.lit("\u00e5\u009b\u00bd "), text)).otherwise(text)
    d = load(spark, sf_dir, "documents").select("doc_id", damaged.alias("text"))
    return d.select("doc_id", F.sha2(N.clean(F.col("text")), 256).alias("cleaned_sha256"), N.has_mojibake(F.col("text")).alias("damaged"))


def news_outcome_counts(spark, sf_dir):
    """News of two types about each advice's symbols, 1, 5 and 20 days on."""
    k = F.col("c_custkey")
    spans = load(spark, sf_dir, "customer").select(F.lpad(k.cast("string"), 6, "0").alias("symbol"), (k % 40).alias("advice_id"), F.explode(F.array(*map(F.lit, (1, 5, 20)))).alias("horizon"))
    spans = spans.withColumn("start_date", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("advice_id") % 15).cast("int"))).withColumn("end_date", F.date_add("start_date", F.col("horizon")))
    return N.outcome_counts(news(spark, sf_dir), spans, "purchase", "click")


QUERIES = {f.__name__: f for f in (news_scan, news_known_counts, news_classify, news_reclassify, news_class_counts, news_block_list, news_block_list_by_score, news_risk_summary, news_coverage, news_upsert, news_evidence, news_text_repair, news_outcome_counts)}

_IN = "event_type IN ('click', 'purchase')"
_HAS = {name: " OR ".join(f"contains(t, '{w}')" for w in words) for name, (_, _, words) in N.KEYWORDS.items()}
_CASE = f"""CASE WHEN {_HAS['exonerating']} THEN 'neutral' WHEN {_HAS['severe_company_risk']} THEN 'severe_company_risk' WHEN {_HAS['company_risk']} THEN 'company_risk'
  WHEN {_HAS['industry_market_flow']} THEN 'industry_market_flow' WHEN {_HAS['general_market_sentiment']} THEN 'general_market_sentiment' ELSE 'neutral' END"""
_LIST = ", ".join(f"'{p}'" for p in PHRASES)
_CLASSES = f"""st AS (SELECT doc_id, ([{_LIST}])[1 + doc_id % {len(PHRASES)}] || ' ' || coalesce(text, '') || CASE WHEN doc_id % 3 = 0 THEN ([{_LIST}])[1 + doc_id * 7 % {len(PHRASES)}] ELSE '' END AS t FROM documents),
c AS (SELECT doc_id, {_CASE} AS event_type FROM st), cl AS (SELECT *, CASE event_type WHEN 'severe_company_risk' THEN 'negative' WHEN 'company_risk' THEN 'risk' ELSE '' END AS label,
  CAST(CASE event_type WHEN 'severe_company_risk' THEN -0.8 WHEN 'company_risk' THEN -0.4 END AS DOUBLE) AS score FROM c)"""
_CLASSED = f"""ti AS (SELECT news_id, symbol, known_at, ([{_LIST}])[1 + news_id * 11 % {len(PHRASES)}] AS t, CASE WHEN news_id % 7 <> 0 THEN (news_id % 10) / 10.0::DOUBLE ELSE 0 END AS relevance FROM news),
k AS (SELECT *, {_CASE} AS event_type FROM ti)"""
ORACLE = {
    "news_scan": f"""WITH {SQL_NEWS} SELECT news_id, symbol, event_type, published_at, fetched_at FROM news WHERE source = 'feed1'
AND (published_at >= '2024-01-05' OR fetched_at >= '2024-01-05') AND published_at <= '2024-01-20' AND fetched_at <= '2024-01-20' ORDER BY published_at DESC, news_id DESC LIMIT 200""",
    "news_known_counts": f"""WITH {SQL_NEWS} SELECT 'observed' AS mode, CAST(known_at AS DATE) AS day, count(*) AS n FROM news GROUP BY ALL
UNION ALL SELECT 'published_at', CAST(published_at AS DATE), count(*) FROM news GROUP BY ALL""",
    "news_classify": f"WITH {_CLASSES} SELECT doc_id, event_type, label, score FROM cl",
    "news_reclassify": f"""WITH {_CLASSES} SELECT doc_id, event_type, label AS sentiment_label, score AS sentiment_score FROM cl
WHERE event_type <> CASE WHEN doc_id % 2 = 0 THEN 'neutral' ELSE 'company_risk' END""",
    "news_class_counts": f"WITH {_CLASSES} SELECT event_type, count(*) AS n FROM c GROUP BY 1",
    "news_block_list": f"""WITH {SQL_NEWS}, {_CLASSED}, d AS (SELECT DISTINCT CAST(ts AS DATE) AS decision_date FROM events)
SELECT DISTINCT decision_date, symbol FROM d JOIN k ON event_type = 'severe_company_risk' AND known_at >= CAST(decision_date - 3 AS TIMESTAMP) AND known_at < CAST(decision_date + 1 AS TIMESTAMP)""",
    "news_block_list_by_score": f"""WITH {SQL_NEWS}, {_CLASSED}, d AS (SELECT DISTINCT CAST(ts AS DATE) AS decision_date FROM events)
SELECT DISTINCT decision_date, symbol FROM d JOIN k ON (event_type IN ('severe_company_risk', 'company_risk')) AND relevance >= 0.3 AND known_at >= CAST(decision_date - 5 AS TIMESTAMP) AND known_at < CAST(decision_date + 1 AS TIMESTAMP)""",
    "news_risk_summary": f"""WITH {SQL_NEWS} SELECT symbol, count(*) AS n, count(*) FILTER ({_IN}) AS n_risk, count(DISTINCT CASE WHEN {_IN} THEN CAST(known_at AS DATE) END) AS risk_days,
(arg_max(news_id, (known_at, news_id)) FILTER ({_IN})) AS latest_risk FROM news GROUP BY 1""",
    "news_coverage": f"WITH {SQL_NEWS} SELECT symbol, count(*) AS n, count(DISTINCT source) AS n_sources, min(published_at) AS first_at, max(published_at) AS last_at FROM news GROUP BY 1",
    "news_upsert": f"""WITH {SQL_NEWS}, a AS (SELECT * FROM news WHERE news_id % 3 <> 0), b AS (SELECT *, round(sentiment_score + 1, 6) AS s2, fetched_at + INTERVAL 1 DAY AS f2 FROM news WHERE news_id % 2 = 0)
SELECT coalesce(a.source, b.source) AS source, coalesce(a.news_id, b.news_id) AS news_id, coalesce(b.symbol, a.symbol) AS symbol, coalesce(b.event_type, a.event_type) AS event_type,
coalesce(b.s2, a.sentiment_score) AS sentiment_score, coalesce(b.published_at, a.published_at) AS published_at, coalesce(a.fetched_at, b.f2) AS fetched_at FROM a FULL JOIN b ON a.source = b.source AND a.news_id = b.news_id""",
    "news_evidence": f"""WITH {SQL_NEWS}, r AS (SELECT symbol, news_id, event_type, row_number() OVER (PARTITION BY symbol ORDER BY CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END, known_at DESC, news_id DESC) AS place FROM news)
SELECT * FROM r WHERE place <= 3""",
    "news_outcome_counts": f"""WITH {SQL_NEWS}, sp AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS symbol, c_custkey % 40 AS advice_id, unnest([1, 5, 20]) AS horizon, DATE '2024-01-01' + CAST(c_custkey % 40 % 15 AS INT) AS d FROM customer)
SELECT advice_id, horizon, count(*) FILTER (event_type = 'purchase') AS severe_count, count(*) FILTER (event_type = 'click') AS risk_count
FROM sp LEFT JOIN news ON news.symbol = sp.symbol AND CAST(known_at AS DATE) > d AND CAST(known_at AS DATE) <= d + horizon GROUP BY 1, 2""",
}
