"""Queries of the cross-sectional, temporal, evaluation and portfolio operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import cross_section as X
from tidemark.operators import evaluation as E
from tidemark.operators import portfolio as P
from tidemark.operators import temporal as T
from tidemark.operators.trading import sessions
from tidemark.plans.expression import compile_frame
from tidemark.queries import query, r6
from tidemark.sources.tables import bars, panel, table

C = F.col
RANK = "(rank() OVER (PARTITION BY {p} ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY {p}, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY {p})"


def _rank(x: str, p: str = "date") -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN {RANK.format(x=x, p=p)} END"


@query("cross_section_basic", f"""s AS (SELECT *, quantile_cont(turnover, 0.05) OVER d AS lo, quantile_cont(turnover, 0.95) OVER d AS hi FROM panel WINDOW d AS (PARTITION BY date))
SELECT instrument, date::VARCHAR AS date, {r6(_rank('turnover'))} AS rank, {r6('(turnover - avg(turnover) OVER (PARTITION BY date)) / nullif(stddev_samp(turnover) OVER (PARTITION BY date), 0)')} AS z,
 {r6('turnover - avg(turnover) OVER (PARTITION BY date)')} AS dev, {r6('CASE WHEN turnover IS NOT NULL THEN least(greatest(turnover, lo), hi) END')} AS clipped,
 {r6('close - avg(close) OVER (PARTITION BY date, industry)')} AS industry_dev FROM s""")
def cross_section_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = C("turnover")
    return panel(spark, sf_dir).select("instrument", "date", X.rank_pct(x, "date").alias("rank"), X.zscore(x, "date").alias("z"), X.demean(x, "date").alias("dev"), X.winsorized(x, 0.05, 0.95, "date").alias("clipped"), X.demean(C("close"), "date", "industry").alias("industry_dev"))


@query("composite_ranks", f"""n AS (SELECT *, -pe AS npe FROM panel) SELECT instrument, date::VARCHAR AS date, {r6(f'({_rank("turnover")}) * 0.5 + ({_rank("npe")}) * 0.3 + ({_rank("close")}) * 0.2')} AS score FROM n""")
def composite_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir).select("instrument", "date", X.composite({"turnover": 0.5, "pe": -0.3, "close": 0.2}).alias("score"))


_RES = """b AS (SELECT *, CASE WHEN turnover IS NOT NULL AND mcap > 0 THEN turnover END AS a, CASE WHEN turnover IS NOT NULL AND mcap > 0 THEN ln(mcap) END AS z FROM panel)"""


@query("neutralize_size", f"""{_RES}, m AS (SELECT date, avg(a) AS ma, avg(z) AS mz, covar_samp(a, z) / nullif(var_samp(z), 0) AS beta, count(a) AS n FROM b GROUP BY date)
SELECT instrument, b.date::VARCHAR AS date, {r6('CASE WHEN n >= 10 THEN a - ma - beta * (z - mz) END')} AS residual FROM b JOIN m ON b.date = m.date""")
def neutralize_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir).select("instrument", "date", X.residual(C("turnover"), F.when(C("mcap") > 0, F.ln("mcap")), "date").alias("residual"))


@query("neutralize_size_industry", f"""{_RES}, g AS (SELECT *, a - avg(a) OVER i AS da, z - avg(z) OVER i AS dz FROM b WINDOW i AS (PARTITION BY date, industry)),
m AS (SELECT date, coalesce(sum(da * dz) / nullif(sum(dz * dz), 0), 0) AS beta, count(da) AS n FROM g GROUP BY date)
SELECT instrument, g.date::VARCHAR AS date, {r6('CASE WHEN n >= 10 THEN da - beta * dz END')} AS residual FROM g JOIN m ON g.date = m.date""")
def neutralize_size_industry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.size_industry_residual(panel(spark, sf_dir), "turnover", "mcap", "industry", "residual").select("instrument", "date", "residual")


@query("neutralize_controls")
def neutralize_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.regression_residual(panel(spark, sf_dir).select("instrument", "date", "turnover", "close", "pe"), "turnover", ["close", "pe"], "residual")


@query("rolling_beta", f"""r AS (SELECT *, close / nullif(lag(close) OVER (PARTITION BY instrument ORDER BY date), 0) - 1 AS r FROM panel), k AS (SELECT *, avg(r) OVER (PARTITION BY date) AS m FROM r),
p AS (SELECT *, CASE WHEN r IS NOT NULL AND m IS NOT NULL THEN r END AS a, CASE WHEN r IS NOT NULL AND m IS NOT NULL THEN m END AS b FROM k)
SELECT instrument, date::VARCHAR AS date, {r6('CASE WHEN count(a) OVER w = 12 THEN (avg(a * b) OVER w - avg(a) OVER w * avg(b) OVER w) / nullif(var_samp(b) OVER w, 0) END')} AS beta
FROM p WINDOW w AS (PARTITION BY instrument ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""")
def rolling_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = compile_frame(panel(spark, sf_dir), {"r": "$close / Ref($close, 1) - 1"}).withColumn("m", F.avg("r").over(Window.partitionBy("date")))
    return r.select("instrument", "date", X.rolling_beta(C("r"), C("m"), 12).alias("beta"))


# --- temporal ---------------------------------------------------------------------------------------------------------

_CAL = "cal AS (SELECT DISTINCT l_shipdate::DATE AS d FROM lineitem WHERE dayofweek(l_shipdate) BETWEEN 1 AND 5)"
_LEDGER = f"""{_CAL}, led AS (
  SELECT o_custkey AS entity, last_day(date_trunc('quarter', o_orderdate)::DATE - INTERVAL 1 DAY)::DATE AS period, o_orderdate::DATE AS disclosed,
    CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS value, o_orderkey FROM orders),
pick AS (SELECT entity, period, disclosed, last(value ORDER BY o_orderkey) AS value FROM led GROUP BY ALL),
eff AS (SELECT p.*, (SELECT min(d) FROM cal WHERE d > p.disclosed) AS effective FROM pick p)"""


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date"))
    return days.where(F.dayofweek("date").between(2, 6)).distinct()


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    value = F.when(C("o_orderkey") % 13 != 0, C("o_totalprice"))
    rows = o.select(C("o_custkey").alias("entity"), F.to_date(F.date_sub(F.date_trunc("quarter", "o_orderdate"), 1)).alias("period"), F.to_date("o_orderdate").alias("disclosed"), value.alias("value"), "o_orderkey")
    return rows.groupBy("entity", "period", "disclosed").agg(F.max_by("value", "o_orderkey").alias("value"))


def effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.visible_from(ledger(spark, sf_dir), "disclosed", calendar(spark, sf_dir)).withColumnRenamed("effective_date", "effective")


@query("strict_next_open_day", f"WITH {_LEDGER} SELECT entity, period::VARCHAR AS period, disclosed::VARCHAR AS disclosed, {r6('value')} AS value, effective::VARCHAR AS effective FROM eff", with_panel=False)
def strict_next_open_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return effective(spark, sf_dir).select("entity", "period", "disclosed", "value", "effective")


@query("conflicting_versions", f"WITH {_LEDGER} SELECT entity, period::VARCHAR AS period, effective::VARCHAR AS effective FROM eff WHERE effective IS NOT NULL GROUP BY ALL HAVING count(DISTINCT value) > 1 OR (count(value) > 0 AND count(value) < count(*))", with_panel=False)
def conflicting_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.conflicts(effective(spark, sf_dir).where("effective IS NOT NULL"), ["entity", "period", "effective"], "value")


@query("newest_visible_period", f"""WITH {_LEDGER}, one AS (SELECT entity, period, effective, last(value ORDER BY disclosed) AS value FROM eff WHERE effective IS NOT NULL GROUP BY ALL),
pts AS (SELECT DISTINCT entity, effective AS pt FROM one),
seen AS (SELECT p.entity, p.pt, o.period, o.value, row_number() OVER (PARTITION BY p.entity, p.pt ORDER BY o.period DESC, o.effective DESC) AS n FROM pts p JOIN one o ON o.entity = p.entity AND o.effective <= p.pt)
SELECT entity, pt::VARCHAR AS effective, period::VARCHAR AS period, {r6('value')} AS value FROM seen WHERE n = 1""", with_panel=False)
def newest_visible_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.newest_period(_one(spark, sf_dir), "entity", "period", "effective", "value")


def _one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return effective(spark, sf_dir).where("effective IS NOT NULL").groupBy("entity", "period", "effective").agg(F.max_by("value", "disclosed").alias("value"))


@query("fiscal_slots", f"""WITH {_LEDGER}, one AS (SELECT entity, period, effective, last(value ORDER BY disclosed) AS value FROM eff WHERE effective IS NOT NULL GROUP BY ALL),
pts AS (SELECT DISTINCT entity, effective AS pt FROM one),
latest AS (SELECT p.entity, p.pt, o.period, o.value, row_number() OVER (PARTITION BY p.entity, p.pt, o.period ORDER BY o.effective DESC) AS n FROM pts p JOIN one o ON o.entity = p.entity AND o.effective <= p.pt),
slot AS (SELECT *, row_number() OVER (PARTITION BY entity, pt ORDER BY period DESC) AS k FROM latest WHERE n = 1)
SELECT entity, pt::VARCHAR AS effective, {', '.join(r6(f'max(CASE WHEN k = {k + 1} THEN value END)') + f' AS q{k}' for k in range(4))} FROM slot GROUP BY entity, pt""", with_panel=False)
def fiscal_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.slots(_one(spark, sf_dir), "entity", "period", "effective", "value", 4)


@query("asof_panel", f"""WITH {_LEDGER}, one AS (SELECT entity, effective, last(value ORDER BY period, disclosed) AS value FROM eff WHERE effective IS NOT NULL GROUP BY ALL),
days AS (SELECT DISTINCT o_custkey AS entity, (date_trunc('month', o_orderdate) + INTERVAL 40 DAY)::DATE AS date FROM orders)
SELECT d.entity, d.date::VARCHAR AS date, {r6('o.value')} AS value FROM days d ASOF LEFT JOIN one o ON d.entity = o.entity AND d.date >= o.effective""", with_panel=False)
def asof_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = effective(spark, sf_dir).where("effective IS NOT NULL").groupBy("entity", "effective").agg(F.max_by("value", F.struct("period", "disclosed")).alias("value"))
    days = table(spark, sf_dir, "orders").select(C("o_custkey").alias("entity"), F.to_date(F.date_trunc("month", "o_orderdate") + F.expr("INTERVAL 40 DAYS")).alias("date")).distinct()
    return T.asof(facts, days, "entity", "effective", "date", ["value"])


@query("latest_versions", """SELECT o_custkey AS entity, o_orderpriority AS kind, first(o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS status,
  round(first(CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END ORDER BY o_totalprice DESC, o_orderkey) FILTER (WHERE o_orderkey % 3 <> 0) + 3.3e-10, 6) + 0.0 AS value FROM orders GROUP BY ALL""", with_panel=False)
def latest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(C("o_custkey").alias("entity"), C("o_orderpriority").alias("kind"), C("o_orderstatus").alias("status"), F.when(C("o_orderkey") % 3 != 0, C("o_totalprice")).alias("value"), "o_totalprice", "o_orderkey")
    return T.latest_versions(o, ["entity", "kind"], [F.desc("o_totalprice"), C("o_orderkey")], ["status", "value"])


@query("merged_intervals", """WITH s AS (SELECT l_suppkey AS entity, l_shipdate::DATE AS a, (l_shipdate + INTERVAL 5 DAY)::DATE AS b FROM lineitem WHERE l_quantity > 40),
m AS (SELECT *, max(b) OVER (PARTITION BY entity ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM m)
SELECT entity, min(a)::VARCHAR AS "start", max(b)::VARCHAR AS "end" FROM i GROUP BY entity, island""", with_panel=False)
def merged_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(C("l_suppkey").alias("entity"), F.to_date("l_shipdate").alias("start"))
    return T.merged_intervals(s.withColumn("end", F.date_add("start", 5)), "entity", "start", "end")


@query("suspension_islands", """f AS (SELECT instrument, date, day_no FROM panel WHERE close IS NULL), g AS (SELECT *, day_no - row_number() OVER (PARTITION BY instrument ORDER BY day_no) AS run FROM f)
SELECT instrument, min(date)::VARCHAR AS "start", max(date)::VARCHAR AS "end", count(*) AS days FROM g GROUP BY instrument, run""")
def suspension_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.islands(panel(spark, sf_dir).where("close IS NULL"), "instrument", "day_no", "date")


@query("covered_days", """SELECT p.instrument, p.date::VARCHAR AS date FROM panel p WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = p.instrument AND l.l_quantity >= 50 AND p.date BETWEEN l.l_shipdate::DATE AND l.l_shipdate::DATE + 20)""".join(["x AS (SELECT 1) ", ""]))
def covered_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "lineitem").where("l_quantity >= 50").select(C("l_suppkey").alias("instrument"), F.to_date("l_shipdate").alias("start"))
    return T.covered(panel(spark, sf_dir).select("instrument", "date"), spans.withColumn("end", F.date_add("start", 20)), "instrument", "date")


@query("active_member_counts", """WITH e AS (SELECT DISTINCT event_type AS entity, user_id AS member, (ts::DATE - DATE '1970-01-01') AS position FROM events),
c AS (SELECT entity, position FROM e UNION SELECT entity, position + 10 FROM e),
n AS (SELECT c.entity, c.position, count(DISTINCT e.member) AS active FROM c LEFT JOIN e ON e.entity = c.entity AND e.position <= c.position AND e.position > c.position - 10 GROUP BY ALL),
w AS (SELECT entity, member, position, lag(position) OVER m AS p, lead(position) OVER m AS q FROM e WINDOW m AS (PARTITION BY entity, member ORDER BY position)),
k AS (SELECT entity, position FROM w WHERE p IS NULL OR position > p + 10 UNION SELECT entity, position + 10 FROM w WHERE q IS NULL OR q > position + 10)
SELECT n.entity, n.position, n.active FROM n JOIN k ON n.entity = k.entity AND n.position = k.position""", with_panel=False)
def active_member_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(C("event_type").alias("entity"), C("user_id").alias("member"), F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("long").alias("position"))
    return T.active_counts(e, "entity", "member", "position", 10)


@query("directional_sums", """SELECT user_id, event_type, ts::DATE::VARCHAR AS date, round(sum(value) + 3.3e-10, 6) + 0.0 AS gross, round(sum(CASE WHEN event_id % 2 = 0 THEN value ELSE -value END) + 3.3e-10, 6) + 0.0 AS net, count(*) AS n FROM events GROUP BY ALL""", with_panel=False)
def directional_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("date", F.to_date("ts"))
    return e.groupBy("user_id", "event_type", "date").agg(F.sum("value").alias("gross"), F.sum(F.when(C("event_id") % 2 == 0, C("value")).otherwise(-C("value"))).alias("net"), F.count("*").alias("n"))


@query("exact_forward_label", f"""x AS (SELECT 1) SELECT p.instrument, p.date::VARCHAR AS date, {r6('q.close / nullif(p.close, 0) - 1')} AS label FROM panel p LEFT JOIN panel q ON q.instrument = p.instrument AND q.day_no = p.day_no + 4""")
def exact_forward_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.forward_label(panel(spark, sf_dir), "close", 4, "label").select("instrument", "date", "label")


@query("limit_status", """SELECT l_orderkey, l_linenumber, CASE WHEN p <= b * 0.9 + 0.005 THEN -1 WHEN p >= b * 1.1 - 0.005 THEN 1 ELSE 0 END AS status FROM
  (SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS p, p_retailprice AS b FROM lineitem JOIN part ON l_partkey = p_partkey)""", with_panel=False)
def limit_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), C("l_partkey") == C("p_partkey"))
    b = C("p_retailprice")
    return joined.select("l_orderkey", "l_linenumber", S.limit_status(C("l_extendedprice") / C("l_quantity"), b * 1.1, b * 0.9).alias("status"))


@query("fiscal_quarters", """SELECT DISTINCT o_orderdate::DATE::VARCHAR AS date, last_day((date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH)::DATE)::VARCHAR AS quarter_end, (date_trunc('quarter', o_orderdate)::DATE - 1)::VARCHAR AS before,
 last_day((last_day((date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH)::DATE) - INTERVAL 12 MONTH)::DATE)::VARCHAR AS year_ago FROM orders""", with_panel=False)
def fiscal_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    q = S.quarter_end(C("date"))
    return d.withColumn("quarter_end", q).select("date", "quarter_end", S.previous_quarter_end(C("quarter_end")).alias("before"), S.same_quarter_last_year(C("quarter_end")).alias("year_ago"))


# --- evaluation -------------------------------------------------------------------------------------------------------

_SIGNALS = {"rev": "0 - (Ref($close, 1) / Ref($close, 5) - 1)", "turn": "Mean(Ref($turnover, 1), 12)", "risk": "Std(Ref($close, 1) / Ref($close, 2) - 1, 12)"}
_FWD = "Ref($close, -4) / $close - 1"


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compile_frame(panel(spark, sf_dir), _SIGNALS | {"label": _FWD})
    return E.stacked(out, list(_SIGNALS), ["instrument", "date", "day_no", "label"])


def _signals_sql() -> str:
    from tidemark.plans.expression import compile_sql

    ctes, columns = compile_sql(_SIGNALS | {"label": _FWD}, "panel")
    parts = " UNION ALL ".join(f"SELECT instrument, date, day_no, {columns['label']} AS label, '{f}' AS factor, {columns[f]} AS value FROM _last" for f in _SIGNALS)
    return f"{ctes},\nlong AS ({parts}), pairs AS (SELECT * FROM long WHERE value IS NOT NULL AND label IS NOT NULL)"


_LONG = _signals_sql()
_IC = f"""{_LONG}, ranked AS (SELECT *, {RANK.format(x='value', p='factor, date')} AS rx, {RANK.format(x='label', p='factor, date')} AS ry FROM pairs),
ics AS (SELECT factor, date, covar_samp(value, label) / nullif(stddev_samp(value) * stddev_samp(label), 0) AS ic, covar_samp(rx, ry) / nullif(stddev_samp(rx) * stddev_samp(ry), 0) AS rank_ic, count(*) AS n FROM ranked GROUP BY factor, date HAVING count(*) >= 20)"""


@query("ic_series", f"{_IC} SELECT factor, date::VARCHAR AS date, {r6('ic')} AS ic, {r6('rank_ic')} AS rank_ic, n FROM ics")
def ic_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.ic_series(signals(spark, sf_dir), "label")


_SUMMARY = f"""{r6('avg(ic)')} AS mean_ic, {r6('stddev_samp(ic)')} AS sd_ic, {r6('avg((ic > 0)::INTEGER)')} AS positive, count(ic) AS days,
 {r6('CASE WHEN stddev_samp(ic) > 0 THEN avg(ic) / stddev_samp(ic) ELSE 0 END')} AS icir, {r6('CASE WHEN avg(ic) >= 0 THEN avg((ic > 0)::INTEGER) ELSE 1 - avg((ic > 0)::INTEGER) END')} AS hit"""


@query("ic_summary", f"{_IC} SELECT factor, {_SUMMARY} FROM ics GROUP BY factor")
def ic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.ic_summary(E.ic_series(signals(spark, sf_dir), "label"), "factor")


@query("ic_by_year", f"{_IC} SELECT factor, year(date)::INTEGER AS year, {_SUMMARY} FROM ics GROUP BY ALL")
def ic_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.ic_summary(E.ic_series(signals(spark, sf_dir), "label").withColumn("year", F.year("date")), "factor", "year")


_BUCKETS = f"""{_LONG}, edges AS (SELECT factor, date, min(value) AS m, list_distinct(quantile_cont(value, [0.2, 0.4, 0.6, 0.8])) AS e FROM pairs GROUP BY ALL),
bucketed AS (SELECT p.*, len(list_filter(e, lambda v: v > m AND v < value)) + 1 AS bucket FROM pairs p JOIN edges USING (factor, date)),
q AS (SELECT factor, date, bucket, avg(label) AS mean_return, count(*) AS n FROM bucketed GROUP BY ALL)"""


@query("quantile_returns", f"{_BUCKETS} SELECT factor, date::VARCHAR AS date, bucket::INTEGER AS bucket, {r6('mean_return')} AS mean_return, n FROM q")
def quantile_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.quantile_returns(signals(spark, sf_dir), "label", 5)


_SPREAD = f"{_BUCKETS}, ls AS (SELECT factor, date, max(CASE WHEN bucket = 5 THEN mean_return END) - max(CASE WHEN bucket = 1 THEN mean_return END) AS spread FROM q GROUP BY ALL)"


@query("long_short_returns", f"{_SPREAD} SELECT factor, date::VARCHAR AS date, {r6('spread')} AS spread FROM ls WHERE spread IS NOT NULL")
def long_short_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.long_short(E.quantile_returns(signals(spark, sf_dir), "label", 5), 5)


@query("hac_significance", f"""{_IC}, d AS (SELECT *, ic - avg(ic) OVER (PARTITION BY factor) AS d FROM ics WHERE ic IS NOT NULL),
l AS (SELECT *, {', '.join(f'd * lag(d, {k}) OVER (PARTITION BY factor ORDER BY date) AS l{k}' for k in range(1, 5))} FROM d)
SELECT factor, {r6('avg(ic)')} AS mean, {r6('avg(ic) / nullif(sqrt(greatest(sum(d * d) / count(d) + ' + ' + '.join(f'2 * (1 - {k} / 5.0) * coalesce(sum(l{k}), 0) / count(d)' for k in range(1, 5)) + ', 0) / count(d)), 0)')} AS t, count(d) AS n FROM l GROUP BY factor""")
def hac_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.hac_t(E.ic_series(signals(spark, sf_dir), "label"), "ic", "date", 4, "factor")


# --- universes and portfolios -----------------------------------------------------------------------------------------

@query("monthly_universe", """m AS (SELECT max(date) AS c FROM panel GROUP BY year(date), month(date)), r AS (SELECT date AS c, instrument, row_number() OVER (PARTITION BY date ORDER BY mcap DESC, instrument) AS n FROM panel WHERE date IN (SELECT c FROM m) AND mcap IS NOT NULL),
d AS (SELECT date, (SELECT max(c) FROM m WHERE c <= date) AS c FROM (SELECT DISTINCT date FROM panel)) SELECT d.date::VARCHAR AS date, r.instrument FROM d JOIN r ON d.c = r.c WHERE n <= 20""")
def monthly_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.monthly_base(panel(spark, sf_dir), "mcap", 20)


_TOP = "top AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY turnover DESC, instrument) AS rank FROM panel WHERE turnover IS NOT NULL QUALIFY rank <= 9)"


@query("tiered_schedule", f"""{_TOP}, t AS (SELECT *, [2.0, 1.25, 0.75][least((rank - 1) * 3 // count(*) OVER (PARTITION BY date), 2) + 1]::DOUBLE AS w FROM top)
SELECT date::VARCHAR AS date, instrument, rank::INTEGER AS rank, {r6('w / sum(w) OVER (PARTITION BY date)')} AS weight FROM t""")
def tiered_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.tiered_weights(P.top_by(panel(spark, sf_dir), "turnover", 9)).select("date", "instrument", "rank", "weight")


@query("set_turnover", f"""{_TOP}, w AS (SELECT day_no, instrument, 1.0 / count(*) OVER (PARTITION BY day_no) AS w FROM top), n AS (SELECT day_no, lead(day_no) OVER (ORDER BY day_no) AS nx FROM (SELECT DISTINCT day_no FROM w)),
b AS (SELECT nx AS p, instrument, w AS a FROM w JOIN n USING (day_no) WHERE nx IS NOT NULL), c AS (SELECT day_no AS p, instrument, w AS b FROM w WHERE day_no IN (SELECT nx FROM n))
SELECT p AS day_no, {r6('sum(abs(coalesce(c.b, 0) - coalesce(b.a, 0))) / 2')} AS turnover FROM b FULL JOIN c USING (p, instrument) GROUP BY p""")
def set_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.bucket_turnover(P.top_by(panel(spark, sf_dir), "turnover", 9), "day_no", "instrument")


_PERF = """WITH r AS (SELECT o_orderpriority AS book, o_orderdate::DATE AS date, avg(o_totalprice) / 1e7 - 0.014 AS r FROM orders GROUP BY ALL),
v AS (SELECT *, exp(sum(ln(1 + r)) OVER w) AS nav FROM r WINDOW w AS (PARTITION BY book ORDER BY date)), d AS (SELECT *, nav / greatest(max(nav) OVER (PARTITION BY book ORDER BY date), 1.0) - 1 AS dd FROM v)"""


def book_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy(C("o_orderpriority").alias("book"), F.to_date("o_orderdate").alias("date")).agg((F.avg("o_totalprice") / 1e7 - 0.014).alias("r"))


@query("drawdowns", f"{_PERF} SELECT book, date::VARCHAR AS date, {r6('nav')} AS nav, {r6('dd')} AS drawdown FROM d", with_panel=False)
def drawdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.drawdowns(book_returns(spark, sf_dir), "r", "date", "book").select("book", "date", "nav", "drawdown")


@query("performance", f"""{_PERF}, s AS (SELECT book, count(r) AS n, arg_max(nav, date) AS g, avg(r) AS m, stddev_samp(r) AS sd, sqrt(avg(pow(least(r, 0), 2))) AS down, min(dd) AS mdd, avg((r > 0)::INTEGER) AS win FROM d GROUP BY book)
SELECT book, n, {r6('g - 1')} AS total_return, {r6('pow(g, 252.0 / n) - 1')} AS annual_return, {r6('sd * sqrt(252)')} AS volatility, {r6('m / nullif(sd, 0) * sqrt(252)')} AS sharpe, {r6('m / nullif(down, 0) * sqrt(252)')} AS sortino,
 {r6('mdd')} AS max_drawdown, {r6('(pow(g, 252.0 / n) - 1) / nullif(-mdd, 0)')} AS calmar, {r6('win')} AS win_rate FROM s""", with_panel=False)
def performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.performance(book_returns(spark, sf_dir), "r", "date", 252.0, "book")


@query("trade_costs", """SELECT l_orderkey, l_linenumber, round(greatest(l_extendedprice * 0.0003, 5.0) + l_extendedprice * 0.00001 + 3.3e-10, 6) + 0.0 AS buy, round(greatest(l_extendedprice * 0.0003, 5.0) + l_extendedprice * 0.00001 + l_extendedprice * 0.0005 + 3.3e-10, 6) + 0.0 AS sell FROM lineitem""", with_panel=False)
def trade_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", P.buy_cost(C("l_extendedprice")).alias("buy"), P.sell_cost(C("l_extendedprice")).alias("sell"))


@query("order_simulation")
def order_simulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir)
    picks = P.equal_weights(P.top_by(p.where("day_no % 4 = 0"), "turnover", 10)).select(F.lit("turnover").alias("scenario"), "date", "instrument", "weight")
    more = P.equal_weights(P.top_by(p.where("day_no % 4 = 0"), "mcap", 10)).select(F.lit("size").alias("scenario"), "date", "instrument", "weight")
    gated = sessions(p, F.lit(0.3), 5)
    return P.simulate(picks.union(more), gated.select("date", "instrument", "open", "close", "vol", "up", "down"), 1e7)


@query("coverage_audit", """x AS (SELECT 1) SELECT instrument, count(*) AS days, count(close) AS known, min(date)::VARCHAR AS first_day, max(date)::VARCHAR AS last_day, round(avg((close IS NULL)::INTEGER) + 3.3e-10, 6) + 0.0 AS missing FROM panel GROUP BY instrument""")
def coverage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir).groupBy("instrument").agg(F.count("*").alias("days"), F.count("close").alias("known"), F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.avg(C("close").isNull().cast("double")).alias("missing"))


@query("observed_bars", f"x AS (SELECT 1) SELECT instrument, date::VARCHAR AS date, {', '.join(f'{r6(c)} AS {c}' for c in ('open', 'high', 'low', 'close', 'vol', 'amount'))} FROM bars")
def observed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir)
