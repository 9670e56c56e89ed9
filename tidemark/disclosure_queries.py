"""Queries of the disclosure operators, each with its SQL. Orders stand for filings, events for analysts' reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import disclosures as D
from tidemark.panel_queries import _LEDGER, _one
from tidemark.queries import query, r6
from tidemark.sources.tables import panel, table

C = F.col
_BEFORE = "(date_trunc('quarter', {p})::DATE - 1)"
_ONE = f"{_LEDGER}, one AS (SELECT entity, period, effective, last(value ORDER BY disclosed) AS value FROM eff WHERE effective IS NOT NULL GROUP BY ALL)"
_STATE = f"""{_ONE}, pts AS (SELECT DISTINCT entity, effective AS pt FROM one),
seen AS (SELECT p.entity, p.pt, o.period, o.value, row_number() OVER (PARTITION BY p.entity, p.pt, o.period ORDER BY o.effective DESC) AS n FROM pts p JOIN one o ON o.entity = p.entity AND o.effective <= p.pt),
state AS (SELECT entity, pt, period, value, row_number() OVER (PARTITION BY entity, pt ORDER BY period DESC) AS k FROM seen WHERE n = 1)"""
_QUARTERS = f"""{_STATE}, sq AS (SELECT s.entity, s.pt, s.period, s.k, CASE WHEN month(s.period) = 3 THEN s.value ELSE s.value - b.value END AS v
  FROM state s LEFT JOIN state b ON b.entity = s.entity AND b.pt = s.pt AND b.period = {_BEFORE.format(p='s.period')}),
w AS (SELECT entity, pt, {', '.join(f'max(CASE WHEN k = {k + 1} THEN v END) AS q{k}' for k in range(4))}, max(period) AS newest FROM sq GROUP BY entity, pt)"""


@query("single_quarters", f"""WITH {_QUARTERS} SELECT w.entity, w.pt::VARCHAR AS effective, {', '.join(r6(f'q{k}') + f' AS sq_q{k}' for k in range(4))}, {r6('q0 + q1 + q2 + q3')} AS ttm,
 {r6('(q0 - y.v) / nullif(abs(y.v), 0)')} AS yoy, {r6('(q0 - b.v) / nullif(abs(b.v), 0)')} AS qoq FROM w LEFT JOIN sq y ON y.entity = w.entity AND y.pt = w.pt AND y.period = last_day(w.newest - INTERVAL 12 MONTH)
 LEFT JOIN sq b ON b.entity = w.entity AND b.pt = w.pt AND b.period = {_BEFORE.format(p='w.newest')}""", with_panel=False)
def single_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.quarters(_one(spark, sf_dir), "entity", "period", "effective", "value")


@query("earnings_stability", f"WITH {_STATE} SELECT entity, pt::VARCHAR AS effective, {r6('CASE WHEN count(value) FILTER (k <= 12) >= 3 THEN stddev_pop(value) FILTER (k <= 12) END')} AS stability FROM state GROUP BY entity, pt", with_panel=False)
def earnings_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.stability(_one(spark, sf_dir), "entity", "period", "effective", "value", 12, 3)


_CANONICAL = f"""{_ONE}, newest AS (SELECT entity, period, last(value ORDER BY effective) AS v FROM one GROUP BY ALL),
derived AS (SELECT a.entity, a.period, CASE WHEN month(a.period) = 3 THEN a.v ELSE a.v - b.v END AS derived FROM newest a LEFT JOIN newest b ON b.entity = a.entity AND b.period = {_BEFORE.format(p='a.period')}),
direct AS (SELECT entity, period, CASE WHEN entity % 2 = 0 THEN v ELSE v / 2 END AS direct FROM newest WHERE month(period) IN (3, 9)),
both_ AS (SELECT entity, period, direct, derived, coalesce(direct, derived) AS value FROM direct FULL JOIN derived USING (entity, period))"""


def _canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = _one(spark, sf_dir)
    newest = one.groupBy("entity", "period").agg(F.max_by("value", "effective").alias("v"))
    direct = newest.where(F.month("period").isin(3, 9)).select("entity", "period", F.when(C("entity") % 2 == 0, C("v")).otherwise(C("v") / 2).alias("value"))
    return D.canonical_quarters(direct, D.latest_quarters(one, "entity", "period", "effective", "value"), ["entity", "period"], "value")


@query("canonical_quarters", f"WITH {_CANONICAL} SELECT entity, period::VARCHAR AS period, {r6('direct')} AS direct, {r6('derived')} AS derived, {r6('value')} AS value FROM both_", with_panel=False)
def canonical_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _canonical(spark, sf_dir)


@query("quarter_parity", f"""WITH {_CANONICAL} SELECT year(period)::INTEGER AS year, count(*) FILTER (WHERE direct IS NOT NULL AND derived IS NOT NULL) AS "both", count(*) FILTER (WHERE direct IS NOT NULL AND derived IS NULL) AS direct_only,
 count(*) FILTER (WHERE direct IS NULL AND derived IS NOT NULL) AS derived_only, count(*) FILTER (WHERE abs(direct - derived) > 1e-6 * greatest(abs(direct), 1)) AS differing, {r6('max(abs(direct - derived))')} AS max_error FROM both_ GROUP BY year(period)""", with_panel=False)
def quarter_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.parity(_canonical(spark, sf_dir).withColumn("year", F.year("period")), "year")


# --- analysts ---------------------------------------------------------------------------------------------------------

_REPORTS = "rep AS (SELECT user_id AS entity, event_type AS org, ts::DATE AS date, ts, event_id, quarter(ts) AS period, value, CASE WHEN event_id % 7 <> 0 THEN (event_id % 4)::INTEGER END AS level FROM events)"


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    level = F.when(C("event_id") % 7 != 0, (C("event_id") % 4).cast("int"))
    return e.select(C("user_id").alias("entity"), C("event_type").alias("org"), F.to_date("ts").alias("date"), "ts", "event_id", F.quarter("ts").alias("period"), "value", level.alias("level"))


@query("forecast_revisions", f"""WITH {_REPORTS}, d AS (SELECT entity, date, value - lag(value) OVER (PARTITION BY entity, org, period ORDER BY ts, event_id) AS d FROM rep)
SELECT entity, date::VARCHAR AS date, count(*) FILTER (WHERE d > 1e-9) AS up, count(*) FILTER (WHERE d < -1e-9) AS down FROM d GROUP BY ALL""", with_panel=False)
def forecast_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.revisions(reports(spark, sf_dir), ["org", "period"], "entity", "date", ["ts", "event_id"], "value")


@query("forecast_consensus", f"""WITH {_REPORTS}, pts AS (SELECT DISTINCT entity, date AS pt FROM rep),
l AS (SELECT p.entity, p.pt, r.value, row_number() OVER (PARTITION BY p.entity, p.pt, r.org ORDER BY r.date DESC, r.ts DESC, r.event_id DESC) AS n FROM pts p JOIN rep r ON r.entity = p.entity AND r.date <= p.pt AND r.date > p.pt - 20)
SELECT entity, pt::VARCHAR AS date, round(quantile_cont(value, 0.5) + 3.3e-10, 6) + 0.0 AS median, count(value) AS organisations FROM l WHERE n = 1 GROUP BY entity, pt""", with_panel=False)
def forecast_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.consensus(reports(spark, sf_dir), "entity", "org", "date", ["ts", "event_id"], "value", 20)


_SPELLS = f"""{_REPORTS}, rate AS (SELECT entity, org, date, arg_max_null(level, event_id) AS level FROM rep GROUP BY ALL),
b AS (SELECT *, lag(level) OVER w AS b, row_number() OVER w AS n FROM rate WINDOW w AS (PARTITION BY entity, org ORDER BY date)),
t AS (SELECT *, least(date + 15, coalesce(lead(date) OVER (PARTITION BY entity, org ORDER BY date), date + 15)) AS e FROM b WHERE n = 1 OR level IS DISTINCT FROM b),
spell AS (SELECT entity, org, date AS s, e, sign(level - b)::INTEGER AS direction FROM t WHERE level IS NOT NULL AND b IS NOT NULL)"""


def _spells(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = reports(spark, sf_dir).groupBy("entity", "org", "date").agg(F.max_by("level", "event_id").alias("level"))
    return D.rating_episodes(daily, "entity", "org", "date", "level", 15)


@query("rating_spells", f'WITH {_SPELLS} SELECT entity, org, s::VARCHAR AS "start", e::VARCHAR AS "end", direction FROM spell', with_panel=False)
def rating_spells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spells(spark, sf_dir)


@query("rating_balance", f"""WITH {_SPELLS}, m AS (SELECT DISTINCT entity, d FROM (SELECT entity, s AS d FROM spell UNION ALL SELECT entity, e FROM spell))
SELECT m.entity, m.d::VARCHAR AS date, count(*) FILTER (WHERE direction = 1 AND s <= d AND d < e) AS ups, count(*) FILTER (WHERE direction = -1 AND s <= d AND d < e) AS downs FROM m JOIN spell USING (entity) GROUP BY ALL""", with_panel=False)
def rating_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.spell_counts(_spells(spark, sf_dir), "entity")


# --- membership -------------------------------------------------------------------------------------------------------


@query("industry_asof", """WITH s AS (SELECT o_custkey AS entity, o_orderdate::DATE AS a, o_orderdate::DATE + (60 + max(o_orderkey) % 90)::INTEGER AS b, last(o_orderpriority ORDER BY o_orderkey) AS industry FROM orders GROUP BY o_custkey, o_orderdate::DATE),
d AS (SELECT DISTINCT o_custkey AS entity, date_trunc('month', o_orderdate)::DATE + 50 AS date FROM orders)
SELECT d.entity, d.date::VARCHAR AS date, CASE WHEN d.date <= s.b THEN industry END AS industry FROM d ASOF LEFT JOIN s ON d.entity = s.entity AND d.date >= s.a""", with_panel=False)
def industry_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(C("o_custkey").alias("entity"), F.to_date("o_orderdate").alias("a"), "o_orderkey", "o_orderpriority")
    spans = o.groupBy("entity", "a").agg(F.max("o_orderkey").alias("k"), F.max_by("o_orderpriority", "o_orderkey").alias("industry"))
    spans = spans.withColumn("b", F.date_add("a", (60 + C("k") % 90).cast("int")))
    days = o.select("entity", F.date_add(F.date_trunc("month", "a"), 50).alias("date")).distinct()
    return D.member_asof(days, spans, "entity", "date", "a", "b", "industry")


@query("listing_masks", """l AS (SELECT instrument, min(date) + (instrument % 3 * 30)::INTEGER AS a, CASE WHEN instrument % 4 = 0 THEN max(date) - 200 END AS b FROM panel WHERE instrument % 9 <> 0 GROUP BY instrument),
m AS (SELECT p.instrument, p.date, coalesce(p.date >= a AND (b IS NULL OR p.date < b), false) AS listed, p.date - a < 365 AS young FROM panel p LEFT JOIN l USING (instrument))
SELECT instrument, date::VARCHAR AS date, listed, listed AND coalesce(young, false) AS young FROM m""")
def listing_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir).select("instrument", "date")
    spans = p.where("instrument % 9 <> 0").groupBy("instrument").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    listings = spans.select("instrument", F.date_add("a", (C("instrument") % 3 * 30).cast("int")).alias("a"), F.when(C("instrument") % 4 == 0, F.date_sub("b", 200)).alias("b"))
    return D.listing_masks(p, listings, "instrument", "date", "a", "b")
