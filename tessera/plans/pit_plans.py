"""Point-in-time queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import pit as P
from tessera.operators import timeline as T
from tessera.operators import upkeep as U
from tessera.operators.grid import dense_grid
from tessera.plans.factor_plans import SQL_GRID
from tessera.sources.tables import SQL_BARS, SQL_STATUS, SQL_STOCKS, bars, load, status_intervals, stocks

AS_OF = "1998-06-30"


def _asks(spark, sf_dir):
    """Quarterly dates for every symbol that has a status."""
    s = status_intervals(spark, sf_dir).select("symbol").distinct()
    days = F.explode(F.expr("sequence(date'1996-01-01', date'2001-07-01', interval 3 month)")).alias("as_of")
    return s.select("symbol", days)


def status_as_of(spark, sf_dir):
    """Bitemporal status lookups."""
    return P.interval_join(_asks(spark, sf_dir), status_intervals(spark, sf_dir))


def last_close_as_of(spark, sf_dir):
    """Latest close at or before each date; symbols without a bar so far have none."""
    b = bars(spark, sf_dir)
    asks = b.select("symbol").distinct().select("symbol", F.explode(F.expr("sequence(date'1996-01-01', date'2001-07-01', interval 1 month)")).alias("as_of"))
    return P.as_of_join(asks, b, "symbol", "as_of", "trade_date", ("close", "volume"))


def _events(spark, sf_dir):
    return status_intervals(spark, sf_dir).select("symbol", "status", F.col("valid_from").alias("change_date"))


def derived_intervals(spark, sf_dir):
    """Intervals of change events."""
    return P.derive_intervals(_events(spark, sf_dir))


def scd2_reconcile(spark, sf_dir):
    """A snapshot against the rows that are open."""
    now = status_intervals(spark, sf_dir).where("valid_to is null").select("symbol", "status", "valid_from")
    k = F.col("symbol").cast("int")
    then = now.where(k % 11 != 0).select("symbol", F.when(k % 5 == 0, "st").otherwise(F.col("status")).alias("status"))
    extra = now.where(k % 13 == 0).select(F.concat(F.lit("9"), F.substring("symbol", 2, 5)).alias("symbol"), "status")
    return P.reconcile(now, then.unionByName(extra.join(now.select("symbol"), "symbol", "left_anti")), AS_OF)


def _candidates(spark, sf_dir):
    return stocks(spark, sf_dir).select("symbol").union(status_intervals(spark, sf_dir).where("valid_from < date'1997-01-01'").select("symbol")).distinct()


def _names(spark, sf_dir):
    """Names by interval for two thirds of the securities; some bore a risk name until they were renamed."""
    k = F.col("symbol").cast("int")
    base = stocks(spark, sf_dir).where(k % 3 != 0).select("symbol", F.col("name").alias("plain"), k.alias("k"))
    cut = F.lit("1999-01-01").cast("date")
    first = base.select("symbol", F.when(F.col("k") % 5 == 0, F.concat(F.lit("ST "), "plain")).otherwise(F.col("plain")).alias("name"), F.lit("1995-01-01").cast("date").alias("valid_from"),
                        F.when(F.col("k") % 4 == 0, cut).alias("valid_to"), F.lit(None).cast("date").alias("announced_at"))
    second = base.where("k % 4 = 0").select("symbol", F.when(F.col("k") % 7 == 0, F.concat(F.lit("*ST "), "plain")).otherwise(F.col("plain")).alias("name"), cut.alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), cut.alias("announced_at"))
    return first.unionByName(second)


def _mixed(spark, sf_dir):
    """The mixed status table: the intervals of orders, and every security listed from its listing on, half of them without an announcement."""
    k = F.col("symbol").cast("int")
    listed = stocks(spark, sf_dir).select(
        "symbol", F.lit("listed").alias("status"), F.col("list_date").alias("valid_from"), F.when(k % 19 == 0, F.date_add("list_date", 900)).alias("valid_to"), F.when(k % 2 == 0, F.col("list_date")).alias("announced_at"))
    gone = stocks(spark, sf_dir).where(k % 19 == 0).select(
        "symbol", F.lit("delisted").alias("status"), F.date_add("list_date", 900).alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), F.date_add("list_date", 880).alias("announced_at"))
    return status_intervals(spark, sf_dir).unionByName(listed).unionByName(gone)


def _risk(spark, sf_dir):
    """The risk axis, from every fourth order: tiers that overlap each other and the mixed table, some open, some announced late or never."""
    k = F.col("k")
    word = F.element_at(F.array(*map(F.lit, ("normal", "st", "sst", "st_star"))), (F.col("o_orderkey") / 4 % 4).cast("int") + 1)
    o = load(spark, sf_dir, "orders").where(F.col("o_orderkey") % 4 == 0).select(
        F.lpad(F.col("o_custkey").cast("string"), 6, "0").alias("symbol"), word.alias("st_status"), F.date_add(F.col("o_orderdate").cast("date"), 10).alias("valid_from"), "o_orderkey")
    o = o.groupBy("symbol", "st_status", "valid_from").agg(F.min("o_orderkey").alias("k"))
    return o.select("symbol", "st_status", "valid_from", F.when(k % 3 != 0, F.date_add("valid_from", (k % 200 + 1).cast("int"))).alias("valid_to"),
                    F.when(k % 5 != 0, F.date_add("valid_from", (k % 40).cast("int"))).alias("announced_at"))


def status_timeline(spark, sf_dir):
    """Availability, risk tier and name of every security as disjoint intervals."""
    return T.status_timeline(_mixed(spark, sf_dir), _risk(spark, sf_dir), _names(spark, sf_dir))


def status_timeline_as_of(spark, sf_dir):
    """The same at every quarter."""
    return T.timeline_as_of(_asks(spark, sf_dir), status_timeline(spark, sf_dir))


def _constituents(spark, sf_dir):
    """Members of one index a region: suppliers come and go with their nation's number."""
    k = F.col("s_suppkey")
    s = load(spark, sf_dir, "supplier").select(
        F.concat(F.lit("00030"), (F.col("s_nationkey") % 5).cast("string")).alias("index_symbol"), F.lpad(k.cast("string"), 6, "0").alias("symbol"), k.alias("k"), F.date_add(F.lit("1996-01-01").cast("date"), (k % 700).cast("int")).alias("valid_from"))
    return s.select("index_symbol", "symbol", "valid_from", F.when(F.col("k") % 3 == 0, F.date_add("valid_from", 365)).alias("valid_to"), F.when(F.col("k") % 4 != 0, F.date_add("valid_from", (F.col("k") % 50).cast("int"))).alias("announced_at"))


def _index_weights(spark, sf_dir):
    """Weights of the members at bar dates of every second bar."""
    w = bars(spark, sf_dir).where(F.dayofmonth("trade_date") % 2 == 0).select("symbol", "trade_date", F.round(F.col("volume") / 1000, 6).alias("weight"))
    return _constituents(spark, sf_dir).select("index_symbol", "symbol").join(w, "symbol")


def index_members(spark, sf_dir):
    """Members, weights and names of every index at every quarter."""
    days = F.explode(F.expr("sequence(date'1996-01-01', date'2001-07-01', interval 3 month)")).alias("as_of")
    asks = _constituents(spark, sf_dir).select("index_symbol").distinct().select("index_symbol", days)
    return P.index_members(_constituents(spark, sf_dir), _index_weights(spark, sf_dir), _names(spark, sf_dir), asks)


def _pool(spark, sf_dir):
    return P.universe_waterfall(_candidates(spark, sf_dir), stocks(spark, sf_dir), _mixed(spark, sf_dir), _names(spark, sf_dir), bars(spark, sf_dir), AS_OF, st_status=_risk(spark, sf_dir), limit=25)


def pit_universe(spark, sf_dir):
    """The universe of a date with reasons."""
    return _pool(spark, sf_dir)


def pit_universe_report(spark, sf_dir):
    """Its counters."""
    return P.waterfall_report(_pool(spark, sf_dir))


def research_pool_listing(spark, sf_dir):
    """A pool built twice: the second build replaces the first, the older date stays."""
    pool = _pool(spark, sf_dir)
    older, first = P.materialised(pool, "main", "1999-01-04"), P.materialised(pool.where("eligible"), "main", AS_OF)
    stored = P.replace_pool(P.replace_pool(older, first), P.materialised(pool, "main", AS_OF))
    return P.pool_listing(stored, "main", AS_OF)


def pit_universe_counts(spark, sf_dir):
    """Its reasons, counted."""
    return P.waterfall_counts(pit_universe(spark, sf_dir))


def pit_coverage_report(spark, sf_dir):
    """Counts of the six tables."""
    gaps = trade_gaps(spark, sf_dir)
    return P.coverage_report(_mixed(spark, sf_dir), _names(spark, sf_dir), _risk(spark, sf_dir), _constituents(spark, sf_dir), _index_weights(spark, sf_dir), gaps)


def trade_gaps(spark, sf_dir):
    """Missing days with their kind."""
    return P.trade_gaps(dense_grid(bars(spark, sf_dir)), stocks(spark, sf_dir), _mixed(spark, sf_dir))


def _stored_status(spark, sf_dir):
    """The mixed table as it is stored; without an announcement the confidence is medium."""
    return _mixed(spark, sf_dir).withColumns({"source": F.lit("old"), "confidence": F.when(F.col("announced_at").isNull(), "medium").otherwise("high")})


def _fresh_status(spark, sf_dir):
    """A delivery, from every third order and every fifth security: some rows repeat keys, some have bad symbols, words, confidences or intervals, some listings are real."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    symbol = F.concat(F.lit("SZ"), F.lpad(F.col("o_custkey").cast("string"), 6, "0"))
    word = F.element_at(F.array(*map(F.lit, (" ST ", "normal", "Suspended", "st_star", "listed"))), (k % 5 + 1).cast("int"))
    orders = load(spark, sf_dir, "orders").where(k % 3 == 0).select(
        k.alias("seq"), F.when(k % 29 == 0, "bad!").otherwise(symbol).alias("symbol"), F.when(k % 17 == 0, "halted").otherwise(word).alias("status"), d.alias("valid_from"),
        F.when(k % 23 == 0, F.date_sub(d, 1)).when(k % 2 == 0, F.date_add(d, 50)).alias("valid_to"), F.when(k % 7 != 0, d).alias("announced_at"),
        F.when(k % 4 != 0, F.concat(F.lit("feed"), (k % 4).cast("string"))).alias("source"), F.when(k % 19 == 0, "sure").when(k % 3 == 0, "medium").alias("confidence"))
    listed = F.date_sub("list_date", 100)
    s = stocks(spark, sf_dir).where(F.col("symbol").cast("int") % 5 == 0).select(
        (F.col("symbol").cast("long") + 100_000_000).alias("seq"), "symbol", F.lit("Listed").alias("status"), listed.alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), listed.alias("announced_at"),
        F.lit("exchange").alias("source"), F.lit(None).cast("string").alias("confidence"))
    return orders.unionByName(s)


def pit_status_upsert(spark, sf_dir):
    """The status table after a delivery."""
    return U.upserted(_stored_status(spark, sf_dir), _fresh_status(spark, sf_dir), "security_status")


def pit_status_rejects(spark, sf_dir):
    """What the delivery had turned away, with reasons."""
    return U.rejects(_fresh_status(spark, sf_dir), "security_status").select("seq", "symbol", "status", "confidence", "reasons")


def pit_status_spans(spark, sf_dir):
    """Stretches, overlaps and gaps of the risk axis."""
    return U.spans(_risk(spark, sf_dir))


def pit_gap_upsert(spark, sf_dir):
    """The trade-gap table after a delivery that states some days anew, some of them with a word that is none."""
    gaps = trade_gaps(spark, sf_dir).select("symbol", "trade_date", F.lit(True).alias("expected_open"), F.lit(False).alias("has_bar"), "gap_type", F.lit("rule").alias("source"), F.lit("high").alias("confidence"))
    k = F.col("symbol").cast("int") + F.dayofyear("trade_date")
    word = F.when(k % 7 == 0, "halted").otherwise(" Limit_Halt")
    fresh = gaps.where(k % 2 == 0).withColumns({"gap_type": word, "source": F.lit(None).cast("string"), "confidence": F.lit("Low"), "seq": k.cast("long")})
    return U.upserted(gaps, fresh, "security_trade_gap")


def last_wins(spark, sf_dir):
    """Last announced row of each symbol and status."""
    return P.last_wins(status_intervals(spark, sf_dir).drop("valid_to"), ["symbol", "status"], ["announced_at", "valid_from"])


def pit_st_names(spark, sf_dir):
    """Risk class of names."""
    return stocks(spark, sf_dir).select("symbol", "name", P.pit_name_class(F.col("name")).alias("class"))


QUERIES = {f.__name__: f for f in (status_as_of, last_close_as_of, derived_intervals, scd2_reconcile, pit_universe, pit_universe_report, research_pool_listing, pit_universe_counts, status_timeline, status_timeline_as_of, index_members, pit_status_upsert, pit_status_rejects, pit_status_spans, pit_gap_upsert, pit_coverage_report, trade_gaps, last_wins, pit_st_names)}


def _pick(asks: str) -> str:
    return f"""pick AS (SELECT a.symbol, a.as_of, s.status, s.valid_from, row_number() OVER (PARTITION BY a.symbol, a.as_of ORDER BY s.valid_from DESC) AS rn
FROM {asks} a LEFT JOIN status s ON s.symbol = a.symbol AND s.valid_from <= a.as_of AND (s.valid_to IS NULL OR s.valid_to > a.as_of) AND coalesce(s.announced_at, s.valid_from) <= a.as_of)"""


_CLASS = r"""CASE WHEN regexp_matches(name, '^\s*(\*ST|S\*ST)($|\s|[^\x00-\x7F])') THEN 'st_star' WHEN regexp_matches(name, '^\s*SST($|\s|[^\x00-\x7F])') THEN 'sst'
  WHEN regexp_matches(name, '^\s*ST($|\s|[^\x00-\x7F])') THEN 'st' WHEN contains(name, '退') THEN 'st_star' ELSE 'normal' END"""
_NAMES = """pn AS (SELECT symbol, CASE WHEN CAST(symbol AS INT) % 5 = 0 THEN 'ST ' || name ELSE name END AS name, DATE '1995-01-01' AS valid_from, CASE WHEN CAST(symbol AS INT) % 4 = 0 THEN DATE '1999-01-01' END AS valid_to, CAST(NULL AS DATE) AS announced_at FROM stocks WHERE CAST(symbol AS INT) % 3 <> 0
  UNION ALL SELECT symbol, CASE WHEN CAST(symbol AS INT) % 7 = 0 THEN '*ST ' || name ELSE name END, DATE '1999-01-01', NULL, DATE '1999-01-01' FROM stocks WHERE CAST(symbol AS INT) % 3 <> 0 AND CAST(symbol AS INT) % 4 = 0)"""
_MIXED = """mixed AS (SELECT symbol, status, valid_from, valid_to, announced_at FROM status
  UNION ALL SELECT symbol, 'listed', list_date, CASE WHEN CAST(symbol AS INT) % 19 = 0 THEN list_date + 900 END, CASE WHEN CAST(symbol AS INT) % 2 = 0 THEN list_date END FROM stocks
  UNION ALL SELECT symbol, 'delisted', list_date + 900, NULL, list_date + 880 FROM stocks WHERE CAST(symbol AS INT) % 19 = 0)"""
_RISK = """risk AS (SELECT symbol, word, valid_from, CASE WHEN k % 3 <> 0 THEN valid_from + CAST(k % 200 + 1 AS INT) END AS valid_to, CASE WHEN k % 5 <> 0 THEN valid_from + CAST(k % 40 AS INT) END AS announced_at
  FROM (SELECT lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS symbol, (['normal', 'st', 'sst', 'st_star'])[o_orderkey // 4 % 4 + 1] AS word, CAST(o_orderdate AS DATE) + 10 AS valid_from, min(o_orderkey) AS k FROM orders WHERE o_orderkey % 4 = 0 GROUP BY 1, 2, 3))"""
_EVERY = f"""{SQL_STOCKS}, {SQL_STATUS}, {_NAMES}, {_MIXED}, {_RISK}, every AS (SELECT *, greatest(coalesce(announced_at, valid_from), valid_from) AS since, coalesce(valid_to, DATE '9999-12-31') AS until FROM (
  SELECT symbol, CASE WHEN status IN ('st', 'sst', 'st_star') THEN 'legacy' ELSE 'availability' END AS axis, status AS word, valid_from, valid_to, announced_at FROM mixed
  UNION ALL SELECT symbol, 'risk', word, valid_from, valid_to, announced_at FROM risk UNION ALL SELECT symbol, 'name', name, valid_from, valid_to, announced_at FROM pn))"""


def _then(axes: str, what: str = "word") -> str:
    """The latest row's value among the rows of some axes."""
    return f"arg_max({what}, (valid_from, word)) FILTER (axis IN ({axes}))"


def _known(flag: str = "coalesce({}, false)") -> str:
    """The columns of the timeline over the rows of one day."""
    undated = lambda axes: _then(axes, "announced_at IS NULL")
    both = "'availability', 'legacy'"
    flags = (("status", undated(both)), ("st", f"""coalesce({undated("'risk'")}, {undated("'legacy'")})"""), ("name", undated("'name'")))
    return f"""{_then(both)} AS status, {_then(both, 'valid_from')} AS status_from, {_then("'availability'")} AS availability, coalesce({_then("'risk'")}, {_then("'legacy'")}) AS st_status, {_then("'name'")} AS name,
  {', '.join(f'{flag.format(x)} AS {n}_degraded' for n, x in flags)}"""


_KNOWN_COLUMNS = "status, status_from, availability, st_status, name, status_degraded, st_degraded, name_degraded"
_GAPS = """gone AS (SELECT symbol, trade_date AS as_of FROM grid WHERE close IS NULL),
ga AS (SELECT g.symbol, g.as_of, arg_max(m.status, (m.valid_from, m.status)) AS av FROM gone g LEFT JOIN mixed m ON m.symbol = g.symbol AND m.status IN ('listed', 'normal', 'suspended', 'delisted')
  AND m.valid_from <= g.as_of AND (m.valid_to IS NULL OR m.valid_to > g.as_of) AND coalesce(m.announced_at, m.valid_from) <= g.as_of GROUP BY 1, 2),
gaps AS (SELECT ga.symbol, as_of AS trade_date, CASE WHEN list_date > as_of THEN 'new_listing_gap' WHEN av = 'delisted' THEN 'delisted_gap' WHEN av = 'suspended' THEN 'suspended' WHEN av IN ('listed', 'normal') THEN 'provider_gap' ELSE 'unknown' END AS gap_type
  FROM ga LEFT JOIN stocks USING (symbol))"""
# availability and risk are asked apart, each from its own table
_UNIVERSE = f"""WITH {SQL_BARS}, {_EVERY}, cand AS (SELECT symbol FROM stocks UNION SELECT symbol FROM status WHERE valid_from < DATE '1997-01-01'),
valid AS (SELECT * FROM every WHERE since <= DATE '{AS_OF}' AND until > DATE '{AS_OF}'),
av AS (SELECT symbol, arg_max(word, (valid_from, word)) AS av FROM valid WHERE axis = 'availability' GROUP BY 1), ri AS (SELECT symbol, arg_max(word, (valid_from, word)) AS ri FROM valid WHERE axis = 'risk' GROUP BY 1),
le AS (SELECT symbol, arg_max(word, (valid_from, word)) AS le FROM valid WHERE axis = 'legacy' GROUP BY 1), mi AS (SELECT symbol, arg_max(word, (valid_from, word)) AS pit FROM valid WHERE axis IN ('availability', 'legacy') GROUP BY 1),
nm AS (SELECT symbol, arg_max(word, valid_from) AS pname FROM valid WHERE axis = 'name' GROUP BY 1),
n AS (SELECT symbol, count(*) AS n FROM bars WHERE trade_date <= DATE '{AS_OF}' AND trade_date > DATE '{AS_OF}' - 180 GROUP BY 1),
j AS (SELECT c.symbol, pit, av, coalesce(ri, le) AS st, pname, s.name AS sname, s.status AS now, coalesce(n.n, 0) AS n, coalesce({_CLASS.replace('name', 'pname')}, 'normal') AS cls
  FROM cand c LEFT JOIN mi USING (symbol) LEFT JOIN av USING (symbol) LEFT JOIN ri USING (symbol) LEFT JOIN le USING (symbol) LEFT JOIN nm USING (symbol) LEFT JOIN stocks s USING (symbol) LEFT JOIN n USING (symbol)),
u0 AS (SELECT *, CASE WHEN av = 'delisted' THEN 'delisted' WHEN av = 'suspended' THEN 'suspended' WHEN pit IS NULL AND coalesce(now, '') <> 'active' THEN 'not_listed'
  WHEN st <> 'normal' THEN 'st' WHEN st IS NULL AND pname IS NOT NULL AND cls <> 'normal' THEN 'st' WHEN n < 5 THEN 'no_bars' END AS reason FROM j),
u AS (SELECT *, reason IS NULL AND row_number() OVER (PARTITION BY reason IS NULL ORDER BY n DESC, symbol) <= 25 AS selected FROM u0)"""
_FRESH = """fresh AS (SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 29 <> 0 THEN lpad(CAST(o_custkey AS VARCHAR), 6, '0') END AS symbol, CASE WHEN o_orderkey % 17 = 0 THEN 'halted' ELSE (['st', 'normal', 'suspended', 'st_star', 'listed'])[o_orderkey % 5 + 1] END AS status,
  CAST(o_orderdate AS DATE) AS valid_from, CASE WHEN o_orderkey % 23 = 0 THEN CAST(o_orderdate AS DATE) - 1 WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) + 50 END AS valid_to, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS announced_at,
  CASE WHEN o_orderkey % 4 <> 0 THEN 'feed' || CAST(o_orderkey % 4 AS VARCHAR) ELSE 'unknown' END AS source, CASE WHEN o_orderkey % 19 = 0 THEN 'sure' WHEN o_orderkey % 3 = 0 THEN 'medium' ELSE 'high' END AS confidence FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL SELECT CAST(symbol AS BIGINT) + 100000000, symbol, 'listed', list_date - 100, NULL, list_date - 100, 'exchange', 'high' FROM stocks WHERE CAST(symbol AS INT) % 5 = 0),
why AS (SELECT *, array_to_string(list_filter([CASE WHEN symbol IS NULL THEN 'bad_symbol' END, CASE WHEN status = 'halted' THEN 'unknown_word' END, CASE WHEN confidence = 'sure' THEN 'unknown_confidence' END,
  CASE WHEN valid_to <= valid_from THEN 'empty_interval' END], lambda x: x IS NOT NULL), ',') AS reasons FROM fresh)"""
ORACLE = {
    "pit_status_upsert": f"""WITH {SQL_STOCKS}, {SQL_STATUS}, {_MIXED}, {_FRESH},
both_ AS (SELECT symbol, status, valid_from, valid_to, announced_at, 'old' AS source, CASE WHEN announced_at IS NULL THEN 'medium' ELSE 'high' END AS confidence, -1 AS seq FROM mixed
  UNION ALL SELECT symbol, status, valid_from, valid_to, announced_at, source, confidence, seq FROM why WHERE reasons = ''),
last_ AS (SELECT *, row_number() OVER (PARTITION BY symbol, status, valid_from ORDER BY seq DESC) AS rn, coalesce(min(CASE WHEN seq >= 0 THEN seq END) OVER (PARTITION BY symbol, status, valid_from), -1) AS place FROM both_),
k AS (SELECT * FROM last_ WHERE rn = 1), real_ AS (SELECT symbol, valid_from, place FROM k WHERE seq >= 0 AND status = 'listed' AND confidence = 'high' AND announced_at = valid_from)
SELECT symbol, status, valid_from, valid_to, announced_at, source, confidence FROM k WHERE NOT (status = 'listed' AND confidence = 'medium' AND announced_at IS NULL
  AND EXISTS (SELECT 1 FROM real_ r WHERE r.symbol = k.symbol AND r.valid_from < k.valid_from AND r.place > k.place))""",
    "pit_status_rejects": f"WITH {SQL_STOCKS}, {_FRESH} SELECT seq, symbol, status, confidence, reasons FROM why WHERE reasons <> ''",
    "pit_status_spans": f"""WITH {_RISK}, e AS (SELECT symbol, valid_from, coalesce(valid_to, DATE '9999-12-31') AS t FROM risk),
b AS (SELECT *, max(t) OVER (PARTITION BY symbol ORDER BY valid_from, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
i AS (SELECT *, count(*) FILTER (before IS NULL OR valid_from > before) OVER (PARTITION BY symbol ORDER BY valid_from, t ROWS UNBOUNDED PRECEDING) AS span FROM b)
SELECT symbol, min(valid_from) AS span_from, nullif(max(t), DATE '9999-12-31') AS span_to, count(*) AS n_rows, count(*) FILTER (valid_from < before) AS n_overlaps, CAST(max(CASE WHEN valid_from > before THEN date_diff('day', before, valid_from) END) AS INT) AS gap_days FROM i GROUP BY symbol, span""",
    "pit_gap_upsert": f"""WITH {SQL_GRID}, {SQL_STOCKS}, {SQL_STATUS}, {_MIXED}, {_GAPS}, k AS (SELECT *, CAST(symbol AS INT) + dayofyear(trade_date) AS k FROM gaps)
SELECT symbol, trade_date, true AS expected_open, false AS has_bar, CASE WHEN k % 2 = 0 AND k % 7 <> 0 THEN 'limit_halt' ELSE gap_type END AS gap_type, CASE WHEN k % 2 = 0 AND k % 7 <> 0 THEN 'unknown' ELSE 'rule' END AS source,
  CASE WHEN k % 2 = 0 AND k % 7 <> 0 THEN 'low' ELSE 'high' END AS confidence FROM k""",
    "status_as_of": f"""WITH {SQL_STATUS}, asks AS (SELECT symbol, CAST(unnest(generate_series(DATE '1996-01-01', DATE '2001-07-01', INTERVAL 3 MONTH)) AS DATE) AS as_of FROM (SELECT DISTINCT symbol FROM status)), {_pick('asks')}
SELECT symbol, as_of, valid_from, status FROM pick WHERE rn = 1""",
    "last_close_as_of": f"""WITH {SQL_BARS}, asks AS (SELECT symbol, CAST(unnest(generate_series(DATE '1996-01-01', DATE '2001-07-01', INTERVAL 1 MONTH)) AS DATE) AS as_of FROM (SELECT DISTINCT symbol FROM bars))
SELECT a.symbol, a.as_of, b.trade_date AS row_time, b.close, b.volume FROM asks a ASOF LEFT JOIN bars b ON a.symbol = b.symbol AND a.as_of >= b.trade_date""",
    "derived_intervals": f"""WITH {SQL_STATUS}, m AS (SELECT *, lag(status) OVER (PARTITION BY symbol ORDER BY valid_from) AS before FROM status)
SELECT symbol, status, valid_from, lead(valid_from) OVER (PARTITION BY symbol ORDER BY valid_from) AS valid_to FROM m WHERE coalesce(before, 'normal') <> status""",
    "scd2_reconcile": f"""WITH {SQL_STATUS}, now AS (SELECT symbol, status, valid_from FROM status WHERE valid_to IS NULL),
nxt AS (SELECT symbol, CASE WHEN CAST(symbol AS INT) % 5 = 0 THEN 'st' ELSE status END AS status FROM now WHERE CAST(symbol AS INT) % 11 <> 0
  UNION ALL SELECT '9' || substr(symbol, 2, 5), status FROM now WHERE CAST(symbol AS INT) % 13 = 0 AND ('9' || substr(symbol, 2, 5)) NOT IN (SELECT symbol FROM now)),
b AS (SELECT coalesce(a.symbol, n.symbol) AS symbol, a.status AS old, n.status AS new, a.valid_from, coalesce(a.status = n.status, false) AS same FROM now a FULL JOIN nxt n ON a.symbol = n.symbol)
SELECT symbol, old AS status, valid_from, CAST(NULL AS DATE) AS valid_to, 'kept' AS action FROM b WHERE same
UNION ALL SELECT symbol, old, valid_from, DATE '{AS_OF}', 'closed' FROM b WHERE NOT same AND old IS NOT NULL AND valid_from < DATE '{AS_OF}'
UNION ALL SELECT symbol, new, DATE '{AS_OF}', NULL, 'opened' FROM b WHERE NOT same AND new IS NOT NULL""",
    "pit_universe": f"""{_UNIVERSE} SELECT symbol, reason IS NULL AS eligible, reason AS exclusion_reason, coalesce(pname, sname) AS name, coalesce(pit, now) AS status_at, av AS availability, st AS st_status, n AS n_bars,
  pit IS NULL AS missing_status, pname IS NULL AS missing_name, st IS NULL AS missing_st, pit IS NULL OR pname IS NULL OR st IS NULL AS degraded, 129 AS expected_trading_days, 5 AS least_trading_days, selected FROM u""",
    "pit_universe_report": f"""{_UNIVERSE} SELECT count(*) AS total_candidates, count(*) FILTER (reason IS NULL) AS eligible_count, count(*) FILTER (selected) AS selected_count,
  {', '.join(f"count(*) FILTER (reason = '{r}') AS excluded_{r}" for r in ('delisted', 'suspended', 'not_listed', 'st', 'no_bars'))}, count(*) FILTER (pit IS NULL) AS missing_status_rows, count(*) FILTER (pname IS NULL) AS missing_name_rows,
  count(*) FILTER (st IS NULL) AS missing_st_rows, bool_or(pit IS NULL OR pname IS NULL OR st IS NULL) AS pit_degraded, 129 AS expected_trading_days, 5 AS least_trading_days FROM u""",
    "status_timeline": f"""WITH {_EVERY}, r AS (SELECT * FROM every WHERE since < until), t AS (SELECT symbol, since AS t FROM r UNION SELECT symbol, until FROM r), seg AS (SELECT symbol, t, lead(t) OVER (PARTITION BY symbol ORDER BY t) AS nxt FROM t),
s AS (SELECT seg.symbol, t, nxt, {_known()} FROM seg JOIN r ON r.symbol = seg.symbol AND r.since <= t AND r.until > t WHERE nxt IS NOT NULL GROUP BY ALL),
m AS (SELECT *, lag(nxt) OVER w IS DISTINCT FROM t OR lag(({_KNOWN_COLUMNS})) OVER w IS DISTINCT FROM ({_KNOWN_COLUMNS}) AS fresh FROM s WINDOW w AS (PARTITION BY symbol ORDER BY t)),
g AS (SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY symbol ORDER BY t) AS island FROM m)
SELECT symbol, min(t) AS valid_from, nullif(max(nxt), DATE '9999-12-31') AS valid_to, {_KNOWN_COLUMNS} FROM g GROUP BY symbol, island, {_KNOWN_COLUMNS}""",
    "status_timeline_as_of": f"""WITH {_EVERY}, asks AS (SELECT symbol, CAST(unnest(generate_series(DATE '1996-01-01', DATE '2001-07-01', INTERVAL 3 MONTH)) AS DATE) AS as_of FROM (SELECT DISTINCT symbol FROM status))
SELECT a.symbol, a.as_of, {_known("CASE WHEN count(e.symbol) > 0 THEN coalesce({}, false) END")} FROM asks a LEFT JOIN every e ON e.symbol = a.symbol AND since <= as_of AND until > as_of GROUP BY 1, 2""",
    "index_members": f"""WITH {SQL_BARS}, {SQL_STOCKS}, {_NAMES}, con AS (SELECT '00030' || CAST(s_nationkey % 5 AS VARCHAR) AS index_symbol, lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS symbol, s_suppkey AS k, DATE '1996-01-01' + CAST(s_suppkey % 700 AS INT) AS valid_from FROM supplier),
con2 AS (SELECT *, CASE WHEN k % 3 = 0 THEN valid_from + 365 END AS valid_to, CASE WHEN k % 4 <> 0 THEN valid_from + CAST(k % 50 AS INT) END AS announced_at FROM con),
wt AS (SELECT index_symbol, symbol, trade_date, round(volume / 1000, 6) AS weight FROM bars JOIN con USING (symbol) WHERE day(trade_date) % 2 = 0),
asks AS (SELECT index_symbol, CAST(unnest(generate_series(DATE '1996-01-01', DATE '2001-07-01', INTERVAL 3 MONTH)) AS DATE) AS as_of FROM (SELECT DISTINCT index_symbol FROM con)),
mem AS (SELECT a.index_symbol, a.as_of, c.symbol, c.valid_from, CASE WHEN c.announced_at IS NULL THEN 'medium' ELSE 'high' END AS confidence FROM asks a JOIN con2 c ON c.index_symbol = a.index_symbol AND c.valid_from <= as_of AND (valid_to IS NULL OR valid_to > as_of) AND coalesce(announced_at, c.valid_from) <= as_of),
nm AS (SELECT m.symbol, m.as_of, arg_max(p.name, p.valid_from) AS name FROM (SELECT DISTINCT symbol, as_of FROM mem) m JOIN pn p ON p.symbol = m.symbol AND p.valid_from <= as_of AND (p.valid_to IS NULL OR p.valid_to > as_of) AND coalesce(p.announced_at, p.valid_from) <= as_of GROUP BY 1, 2)
SELECT m.index_symbol, m.as_of, m.symbol, nm.name, w.weight, m.valid_from, m.confidence FROM mem m ASOF LEFT JOIN wt w ON w.index_symbol = m.index_symbol AND w.symbol = m.symbol AND w.trade_date <= m.as_of LEFT JOIN nm ON nm.symbol = m.symbol AND nm.as_of = m.as_of""",
    "research_pool_listing": f"{_UNIVERSE} SELECT 'main' AS pool_key, DATE '{AS_OF}' AS as_of, symbol, reason IS NULL AS eligible, reason AS exclusion_reason, coalesce(pname, sname) AS name_at, coalesce(pit, now) AS status_at FROM u",
    "pit_universe_counts": f"{_UNIVERSE} SELECT coalesce(reason, 'eligible') AS reason, count(*) AS n FROM u GROUP BY 1",
    "pit_coverage_report": f"""WITH {SQL_GRID}, {SQL_STOCKS}, {SQL_STATUS}, {_NAMES}, {_MIXED}, {_RISK}, {_GAPS},
wt AS (SELECT count(*) AS n FROM bars JOIN supplier ON symbol = lpad(CAST(s_suppkey AS VARCHAR), 6, '0') WHERE day(trade_date) % 2 = 0)
SELECT (SELECT count(*) FROM mixed) AS security_status_rows, (SELECT count(*) FROM mixed WHERE announced_at IS NULL) AS status_missing_announced_at, (SELECT count(*) FROM pn) AS security_name_rows,
  (SELECT count(*) FROM pn WHERE announced_at IS NULL) AS name_missing_announced_at, (SELECT count(*) FROM risk) AS security_st_status_rows, (SELECT count(*) FROM risk WHERE announced_at IS NULL) AS st_status_missing_announced_at,
  (SELECT count(*) FROM supplier) AS index_constituent_rows, (SELECT n FROM wt) AS index_weight_snapshot_rows, (SELECT count(*) FROM gaps) AS security_trade_gap_rows,
  (SELECT count(*) FROM gaps WHERE gap_type = 'provider_gap') AS provider_gap_rows, true AS pit_ready""",
    "trade_gaps": f"WITH {SQL_GRID}, {SQL_STOCKS}, {SQL_STATUS}, {_MIXED}, {_GAPS} SELECT * FROM gaps",
    "last_wins": f"WITH {SQL_STATUS} SELECT symbol, status, valid_from, announced_at FROM (SELECT *, row_number() OVER (PARTITION BY symbol, status ORDER BY announced_at DESC, valid_from DESC) AS rn FROM status) WHERE rn = 1",
    "pit_st_names": f"WITH {SQL_STOCKS} SELECT symbol, name, {_CLASS} AS class FROM stocks",
}
