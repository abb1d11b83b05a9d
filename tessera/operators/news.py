"""News: text repair, event classes, knowledge time, block lists, summaries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Keywords by class, the first class that a text meets counts; (label, score, keywords).
KEYWORDS: dict[str, tuple[str, float | None, tuple[str, ...]]] = {
    "exonerating": ("", None, ("预亏变预盈", "亏损收窄", "扭亏为盈", "胜诉", "解除风险", "调查显示", "退市新规", "减持新规", "异动拉升", "涨停", "利好")),
    "severe_company_risk": ("negative", -0.8, ("立案调查", "证监会立案", "行政处罚", "处罚决定", "财务造假", "债务违约", "债务逾期", "资不抵债", "破产", "破产重整", "终止上市", "强制退市")),
    "company_risk": ("risk", -0.4, ("减持", "风险提示", "监管函", "问询函", "警示函", "亏损")),
    "industry_market_flow": ("", None, ("净流出",)),
    "general_market_sentiment": ("", None, ("下跌", "跌停", "异动")),
}
#: Classes whose items count as neutral news.
NEUTRAL = ("exonerating",)


def classify(title: Column, body: Column | None = None, keywords: dict | None = None) -> Column:
    """struct(event_type, label, score): the first class of which "title body" holds a keyword, else neutral without a score."""
    nothing = F.struct(F.lit("neutral").alias("event_type"), F.lit("").alias("label"), F.lit(None).cast("double").alias("score"))
    text = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(body, F.lit("")) if body is not None else F.lit(""))
    out = nothing
    for name, (label, score, words) in reversed((keywords or KEYWORDS).items()):
        hit = text.rlike("|".join(re.escape(w) for w in words))
        found = F.struct(F.lit(name).alias("event_type"), F.lit(label).alias("label"), F.lit(score).cast("double").alias("score"))
        out = F.when(hit, nothing if name in NEUTRAL else found).otherwise(out)
    return out


def reclassified(news: DataFrame) -> DataFrame:
    """Stored items whose class, label or score the present keywords change: the update that a store applies by key."""
    fresh = news.withColumn("_c", classify(F.col("title"), F.col("body")))
    changed = ~(F.col("event_type").eqNullSafe(F.col("_c.event_type")) & F.col("sentiment_label").eqNullSafe(F.col("_c.label")) & F.col("sentiment_score").eqNullSafe(F.col("_c.score")))
    return fresh.where(changed).withColumns({"event_type": F.col("_c.event_type"), "sentiment_label": F.col("_c.label"), "sentiment_score": F.col("_c.score")}).drop("_c")


# Letters that tell of UTF-8 read as a single-byte code; control characters weigh twice.
MARKERS = "ÃÂâåæçèéï¼½äð"
#: The letters that Windows-1252 has in place of the control characters of Latin-1, each with its byte.
_WINDOWS = {bytes([b]).decode("cp1252"): b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def _penalty(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[{MARKERS}]")) + 2 * F.regexp_count(text, F.lit(r"[\x{80}-\x{9f}]"))


def _reads(text: Column) -> Column:
    """How well a text reads: Chinese letters count for it, marks of damage against it."""
    return 3 * F.regexp_count(text, F.lit(r"[\x{4e00}-\x{9fff}]")) - 4 * _penalty(text) - 8 * F.regexp_count(text, F.lit(r"\x{fffd}"))


def has_mojibake(text: Column) -> Column:
    """Whether a text bears two or more marks of damage; false for null."""
    return F.coalesce(_penalty(text) >= 2, F.lit(False))


def repaired(text: Column) -> Column:
    """The text, or what its bytes say as UTF-8 where it reads better: bytes of Latin-1, then of Windows-1252; the first of equals.

    All in the JVM: a text is encoded only where every letter has a byte, and
    bytes that are no UTF-8 give no reading.
    """
    read = lambda t: F.try_validate_utf8(F.encode(t, "ISO-8859-1").cast("string"))
    letters, controls = "".join(_WINDOWS), "".join(map(chr, _WINDOWS.values()))
    latin = F.when(text.rlike(r"\A[\x{0}-\x{ff}]*\z"), read(text))
    windows = F.when(text.rlike(rf"\A[\x{{0}}-\x{{7f}}\x{{a0}}-\x{{ff}}{letters}]*\z"), read(F.translate(text, letters, controls)))
    # ASCII alone reads the same in every code
    tries = F.array_compact(F.array(text, latin, windows))
    scored = F.transform(tries, lambda t, i: F.struct(_reads(t).alias("s"), (-i).alias("i"), t.alias("t")))
    return F.when(text.rlike(r"[^\x{0}-\x{7f}]"), F.array_max(scored)["t"]).otherwise(text)


def clean(text: Column) -> Column:
    """Repaired text without control characters, white space as single spaces, none at the ends; null stays null."""
    bare = F.regexp_replace(repaired(text), r"[\x{0}-\x{8}\x{b}\x{c}\x{e}-\x{1f}\x{7f}-\x{9f}]", " ")
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))


def cleaned(value: Column, kind: T.DataType) -> Column:
    """A value of any schema with every string in it cleaned: in structs, arrays, and the keys and values of maps."""
    if isinstance(kind, T.StringType):
        return clean(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: cleaned(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(cleaned(value[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    if isinstance(kind, T.MapType):
        pairs = F.transform(F.map_entries(value), lambda e: F.struct(cleaned(e["key"], kind.keyType).alias("key"), cleaned(e["value"], kind.valueType).alias("value")))
        # keys that become equal: the later one counts
        last = F.filter(pairs, lambda e, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda o: o["key"] == e["key"]))
        return F.map_from_entries(last)
    return value


def clean_payload(payloads: DataFrame) -> DataFrame:
    """A table of raw payloads with every string of every column cleaned."""
    return payloads.select(*(cleaned(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in payloads.schema.fields))


def news_id(source: Column, symbol: Column, title: Column, published: Column) -> Column:
    """SHA-1 id of an item without an address."""
    return F.sha1(F.concat_ws("|", source, symbol, title, published.cast("string")))


def known(news: DataFrame, mode: str = "observed") -> DataFrame:
    """Adds known_at: the later of publication and fetch, or publication alone."""
    if mode not in ("observed", "published_at"):
        raise ValueError("mode is observed or published_at")
    return news.withColumn("known_at", F.greatest("published_at", "fetched_at") if mode == "observed" else F.col("published_at"))


def scan(news: DataFrame, symbol: str | None = None, source: str | None = None, known_start: str | None = None, known_end: str | None = None, limit: int = 200) -> DataFrame:
    """Newest first. A known range starts where either time does and ends where both do."""
    out = news
    if symbol:
        out = out.where(F.col("symbol") == symbol)
    if source:
        out = out.where(F.col("source") == source)
    if known_start:
        out = out.where((F.col("published_at") >= known_start) | (F.col("fetched_at") >= known_start))
    if known_end:
        out = out.where((F.col("published_at") <= known_end) & (F.col("fetched_at") <= known_end))
    return out.orderBy(F.desc("published_at"), F.desc("news_id")).limit(max(1, min(limit, 5000)))


def upsert(stored: DataFrame, fresh: DataFrame, keys: tuple[str, ...] = ("source", "news_id")) -> DataFrame:
    """Merge by key; fresh values win, the first fetch time stays."""
    a, b = stored.alias("a"), fresh.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    joined = a.join(b, on, "full_outer")
    pick = [F.coalesce(f"a.{c}", f"b.{c}").alias(c) if c in ("fetched_at", *keys) else F.when(F.col(f"b.{keys[0]}").isNotNull(), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in stored.columns]
    return joined.select(*pick)


# Event types and labels that count as risk where no types are asked for.
RISK_TYPES, RISK_LABELS = ("negative_news", "risk_news"), ("negative", "risk", "bearish", "bad")


def risky(news: DataFrame, types: tuple[str, ...] = ("severe_company_risk",), least_relevance: float = 0.0, most_sentiment: float = -0.2) -> DataFrame:
    """The items that block: of the types asked for or, without types, of a risk type or label, or with a score of at most most_sentiment.

    Labels and types are compared in lower case without outer spaces. Columns
    that are missing have their neutral value: label and type empty, score
    null, relevance 1; a null relevance is 0.
    """
    has = lambda c, other: F.col(c) if c in news.columns else other
    word = lambda c: F.lower(F.trim(F.coalesce(has(c, F.lit("")), F.lit(""))))
    relevance = F.coalesce(has("relevance_score", F.lit(1.0)).cast("double"), F.lit(0.0))
    if types:
        risk = word("event_type").isin(*types)
    else:
        risk = word("event_type").isin(*RISK_TYPES) | word("sentiment_label").isin(*RISK_LABELS) | F.coalesce(has("sentiment_score", F.lit(None)).cast("double") <= most_sentiment, F.lit(False))
    return news.where((relevance >= least_relevance) & risk)


def block_list(news: DataFrame, decisions: DataFrame, days: int = 3, types: tuple[str, ...] = ("severe_company_risk",), least_relevance: float = 0.0, most_sentiment: float = -0.2) -> DataFrame:
    """decision_date, symbol pairs blocked by risky news known in [date - days, end of date]; ``risky`` says which items count.

    Each item is dealt to the days it blocks, so the join is an equality of
    dates; an item reaches days + 1 of them at most.
    """
    hits = risky(news, types, least_relevance, most_sentiment)
    first = F.to_date("known_at")
    reach = hits.select("symbol", F.explode(F.sequence(first, F.date_add(first, days))).alias("decision_date"), "known_at")
    fits = (F.col("known_at") >= F.date_sub("decision_date", days).cast("timestamp_ntz"))
    return reach.where(fits).join(F.broadcast(decisions.select("decision_date").distinct()), "decision_date").select("decision_date", "symbol").distinct()


def risk_summary(news: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """Per symbol: items, risky ones, days with risk, the latest one."""
    risky = F.col("event_type").isin(*types)
    return news.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(risky).alias("n_risk"), F.countDistinct(F.when(risky, F.to_date("known_at"))).alias("risk_days"),
        F.max_by("news_id", F.when(risky, F.struct("known_at", "news_id"))).alias("latest_risk"))


def coverage(news: DataFrame) -> DataFrame:
    """Per symbol: items, sources, first and last publication."""
    return news.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("n_sources"), F.min("published_at").alias("first_at"), F.max("published_at").alias("last_at"))


def evidence(news: DataFrame, priority: tuple[str, ...], top: int = 20) -> DataFrame:
    """The most urgent, then newest, items of each symbol."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, priority)), F.col("event_type")), F.lit(0))
    rank = F.when(rank == 0, len(priority) + 1).otherwise(rank)
    w = Window.partitionBy("symbol").orderBy(rank, F.desc("known_at"), F.desc("news_id"))
    return news.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


def outcome_counts(news: DataFrame, spans: DataFrame, severe: str = "severe_company_risk", risk: str = "company_risk") -> DataFrame:
    """advice_id, horizon, severe_count, risk_count: news about an advice's symbols known after start_date and by the end of end_date.

    ``spans`` holds advice_id, horizon, symbol, start_date, end_date. Counts
    of a span are running counts at its end less those at its start, so a
    symbol with much news and many spans is sorted once, never multiplied.
    """
    none = F.lit(None)
    daily = news.groupBy("symbol", F.to_date("known_at").alias("day")).agg(F.count_if(F.col("event_type") == severe).alias("s"), F.count_if(F.col("event_type") == risk).alias("r"))
    asks = [
        spans.select("symbol", F.col(f"{end}_date").alias("day"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("r"), F.lit(sign).alias("sign"), "advice_id", "horizon")
        for end, sign in (("start", -1), ("end", 1))]
    rows = daily.withColumns({"sign": F.lit(0), "advice_id": none.cast(spans.schema["advice_id"].dataType), "horizon": none.cast(spans.schema["horizon"].dataType)})
    rows = rows.unionByName(asks[0]).unionByName(asks[1])
    # a range frame: the news of a day counts for every ask of that day
    w = Window.partitionBy("symbol").orderBy("day").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    known_then = rows.withColumns({"_s": F.sum("s").over(w), "_r": F.sum("r").over(w)}).where("sign <> 0")
    return known_then.groupBy("advice_id", "horizon").agg(F.sum(F.col("_s") * F.col("sign")).alias("severe_count"), F.sum(F.col("_r") * F.col("sign")).alias("risk_count"))
