"""Queries of holdings statistics and of status rules, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import cross_section as X
from tidemark.operators import evaluation as E
from tidemark.operators import holdings as H
from tidemark.operators import lifecycle as L
from tidemark.operators import portfolio as P
from tidemark.panel_queries import RANK, _rank
from tidemark.plans.catalog import component
from tidemark.plans.expression import compile_frame, compile_sql
from tidemark.queries import query, r6
from tidemark.selection_queries import _wide, _wide_sql
from tidemark.sources.tables import panel, table
from tidemark.universe_queries import _SESSIONS, _sessions
from tidemark.validation_queries import _FOLDS, _folds

C = F.col
_SPELLS = f"""{_SESSIONS}, mem AS (SELECT date, instrument FROM panel WHERE turnover IS NOT NULL AND day_no % 4 = 0 QUALIFY row_number() OVER (PARTITION BY date ORDER BY turnover DESC, instrument) <= 9),
cal AS (SELECT date, row_number() OVER (ORDER BY date) AS pos, lead(date) OVER (ORDER BY date) AS nx FROM (SELECT DISTINCT date FROM mem)),
runs AS (SELECT instrument, date, pos, nx, pos - row_number() OVER (PARTITION BY instrument ORDER BY pos) AS run FROM mem JOIN cal USING (date)),
sp AS (SELECT instrument, min(date) AS entry, arg_max({{'x': nx}}, pos).x AS exit FROM runs GROUP BY instrument, run),
days AS (SELECT date, row_number() OVER (ORDER BY date) AS pos FROM (SELECT DISTINCT date FROM panel)),
tr AS (SELECT sp.instrument, entry, exit, b.close / a.close - 1 - 0.0005 - 0.0015 AS ret, y.pos - x.pos + 1 AS hold_days FROM sp JOIN panel a ON a.instrument = sp.instrument AND a.date = entry JOIN panel b ON b.instrument = sp.instrument AND b.date = exit
 JOIN days x ON x.date = entry JOIN days y ON y.date = exit WHERE a.close > 0 AND b.close IS NOT NULL),
od AS (SELECT entry AS date, instrument, true AS buy FROM sp UNION ALL SELECT exit, instrument, false FROM sp WHERE exit IS NOT NULL),
ch AS (SELECT od.date, count(*) FILTER (buy) AS bought, count(*) FILTER (NOT buy) AS sold, count(*) FILTER (coalesce(NOT CASE WHEN buy THEN limit_up ELSE limit_down END, false)) AS executable FROM od LEFT JOIN s USING (date, instrument) GROUP BY od.date),
re AS (SELECT mem.date, count(DISTINCT mem.instrument) AS held, any_value(coalesce(bought, 0))::BIGINT AS bought, any_value(coalesce(sold, 0))::BIGINT AS sold, any_value(coalesce(executable, 0))::BIGINT AS executable FROM mem LEFT JOIN ch ON ch.date = mem.date GROUP BY mem.date)"""


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.top_by(panel(spark, sf_dir).where("day_no % 4 = 0"), "turnover", 9).select("date", "instrument")


@query("holding_spells", f"{_SPELLS} SELECT instrument, entry::VARCHAR AS entry, exit::VARCHAR AS exit FROM sp")
def holding_spells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.spells(_members(spark, sf_dir))


@query("trade_returns", f"{_SPELLS} SELECT instrument, entry::VARCHAR AS entry, exit::VARCHAR AS exit, {r6('ret')} AS ret, hold_days FROM tr")
def trade_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.trade_returns(H.spells(_members(spark, sf_dir)), panel(spark, sf_dir), "close", 0.0005, 0.0015).withColumn("hold_days", C("hold_days").cast("long"))


@query("holding_changes", f"{_SPELLS} SELECT date::VARCHAR AS date, held, bought, sold, executable FROM re")
def holding_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.changes(_members(spark, sf_dir), _sessions(spark, sf_dir))


@query("trading_statistics", f"""{_SPELLS}, dr AS (SELECT date, (SELECT max(c.date) FROM cal c WHERE c.date <= days.date) AS r FROM days), ps AS (SELECT dr.date, mem.instrument FROM dr JOIN mem ON mem.date = r),
ta AS (SELECT count(*) AS trades, avg(hold_days) AS hold_days, avg(ret) AS m, avg(ret) FILTER (ret > 0) AS g, avg(ret) FILTER (ret < 0) AS l, avg((ret > 0)::INTEGER) AS w FROM tr),
tb AS (SELECT avg(held) AS held, sum(bought + sold)::BIGINT AS changes, sum(executable) AS ok FROM re), tc AS (SELECT avg(coalesce(vol = 0, true)::INTEGER) AS sus, count(DISTINCT ps.date) AS n_on FROM ps LEFT JOIN panel p ON p.date = ps.date AND p.instrument = ps.instrument), td AS (SELECT count(*) AS n FROM days)
SELECT {r6('coalesce(held, 0)')} AS held, coalesce(changes, 0) AS changes, trades, {r6('coalesce(hold_days, 0)')} AS hold_days, {r6('coalesce(m, 0)')} AS mean_return, {r6('coalesce(g, 0)')} AS mean_gain, {r6('coalesce(l, 0)')} AS mean_loss, {r6('coalesce(w, 0)')} AS win_rate,
 {r6('coalesce(changes * 52.0 / n / held, 0)')} AS turnover, {r6('coalesce(sus, 0)')} AS suspended, {r6('coalesce(ok / changes, 0)')} AS executable, {r6('coalesce(n_on / n, 0)')} AS invested FROM ta, tb, tc, td""")
def trading_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.trading_statistics(_members(spark, sf_dir), _sessions(spark, sf_dir), "close", 52.0)


_HELD = f"{_FOLDS}, h AS (SELECT factor, avg(train_icir) AS inside, avg(validation_icir) AS validation, avg(test_icir) AS outside, avg(consistent::INTEGER) AS share FROM f GROUP BY factor)"


@query("factor_statuses", f"""{_HELD} SELECT factor, CASE WHEN factor <> 'risk' AND abs(validation) >= 0.1 AND share >= 0.7 THEN 'candidate' ELSE 'draft' END AS status,
 CASE WHEN inside IS NULL OR outside IS NULL THEN 'draft' WHEN abs(outside) < 0.03 OR inside * outside < 0 AND abs(inside) >= 0.2 THEN 'deprecated' WHEN inside * outside > 0 AND abs(outside) >= 0.1 AND share >= 0.7 THEN 'candidate' ELSE 'draft' END AS historical,
 CASE WHEN factor = 'rev' THEN outside > 0 AND 4 * outside > 0.2 ELSE outside < 0 AND -4 * outside > 0.2 END AS aligned FROM h""")
def factor_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = _folds(spark, sf_dir).groupBy("factor").agg(F.avg("train_icir").alias("inside"), F.avg("validation_icir").alias("validation"), F.avg("test_icir").alias("outside"), F.avg(C("consistent").cast("double")).alias("share"))
    side = F.when(C("factor") == "rev", " Long").otherwise("short")
    return means.select("factor", L.candidate_status(C("factor") != "risk", C("validation"), C("share")).alias("status"), L.historical_status(F.lit(True), C("inside"), C("outside"), C("share")).alias("historical"),
                        L.aligned_pass(side, C("outside"), C("outside") * 4, 0.2).alias("aligned"))


_STABLE = ", ".join(f"{RANK.format(x=c, p='one')} AS r_{c}" for c in L.STABILITY)


@query("stability_scores", f"""{_FOLDS}, m AS (SELECT factor, 1 AS one, avg(consistent::INTEGER) AS selected, avg(abs(validation_icir)) AS validation, avg(coalesce(abs(CASE WHEN fold % 2 = 0 THEN test_icir END), 0)) AS marginal, avg((abs(train_icir) >= 0.1)::INTEGER) AS passed,
 1 - least(greatest(coalesce(max(CASE WHEN fold % 3 = 0 THEN test_icir END), 0), 0), 1) AS apart FROM f GROUP BY factor), rk AS (SELECT *, {_STABLE} FROM m)
SELECT factor, {', '.join(f'{r6(c)} AS {c}' for c in L.STABILITY)}, {r6(' + '.join(f'{w} * r_{c}' for c, w in L.STABILITY.items()))} AS score FROM rk""")
def stability_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.stability_scores(_folds(spark, sf_dir).select(
        "factor", C("consistent").alias("selected"), "validation_icir", F.when(C("fold") % 2 == 0, C("test_icir")).alias("marginal_icir"), (F.abs("train_icir") >= 0.1).alias("passed"), F.when(C("fold") % 3 == 0, C("test_icir")).alias("max_corr"),
    ))


@query("window_multiplicity", """WITH n AS (SELECT year(o_orderdate)::INTEGER AS win, count(DISTINCT o_custkey % (year(o_orderdate) - 1985)) AS spent FROM orders GROUP BY ALL)
SELECT win, spent, CASE WHEN spent < 5 THEN 'disclose' WHEN spent < 10 THEN 'disclose_acknowledge' ELSE 'require_adjusted_or_override' END AS action FROM n""", with_panel=False)
def window_multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.year("o_orderdate")
    return L.multiplicity(table(spark, sf_dir, "orders").select(year.alias("win"), (C("o_custkey") % (year - 1985)).alias("frozen")), "win", "frozen")


@query("usable_dates", "d AS (SELECT DISTINCT date FROM panel) SELECT date::VARCHAR AS date, (lag(date, 4) OVER (ORDER BY date))::VARCHAR AS usable FROM d")
def usable_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.usable_until(panel(spark, sf_dir), 4)


@query("marginal_ic_of_many", f"""{_wide_sql()}, o AS (SELECT date, label, turn::DOUBLE AS a, rev::DOUBLE AS y, risk::DOUBLE AS z FROM wide WHERE turn IS NOT NULL AND rev IS NOT NULL AND risk IS NOT NULL),
u AS (SELECT date, label, a - avg(a) OVER d - covar_samp(a, y) OVER d / nullif(var_samp(y) OVER d, 0) * (y - avg(y) OVER d) AS a, z - avg(z) OVER d - covar_samp(z, y) OVER d / nullif(var_samp(y) OVER d, 0) * (y - avg(y) OVER d) AS z FROM o WINDOW d AS (PARTITION BY date) QUALIFY count(*) OVER d >= 10),
v AS (SELECT date, label, a - avg(a) OVER d - covar_samp(a, z) OVER d / nullif(var_samp(z) OVER d, 0) * (z - avg(z) OVER d) AS value FROM u WINDOW d AS (PARTITION BY date)),
p AS (SELECT * FROM v WHERE value IS NOT NULL AND label IS NOT NULL) SELECT date::VARCHAR AS date, {r6('covar_samp(value, label) / nullif(stddev_samp(value) * stddev_samp(label), 0)')} AS ic, count(*) AS n FROM p GROUP BY date HAVING count(*) >= 20""")
def marginal_ic_of_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.ic_series(L.marginal_on(_wide(spark, sf_dir), "turn", ["rev", "risk"]), "label").select("date", "ic", "n")


_PARTS = {"com_north": component("change", "diff", ("turnover",), 4), "com_flow": component("change", "rolling_mean", ("amount",), 12)}


def _interaction_sql() -> str:
    ctes, columns = compile_sql(_PARTS, "panel")
    listed = ", ".join(f"{sql} AS {name}" for name, sql in columns.items())
    return f"{ctes}, v AS (SELECT instrument, date, {listed} FROM _last) SELECT instrument, date::VARCHAR AS date, {r6(_rank('com_north') + ' + ' + _rank('com_flow'))} AS resonance FROM v"


@query("component_interaction", _interaction_sql())
def component_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of two components of a date, added; null if either is."""
    v = compile_frame(panel(spark, sf_dir), _PARTS)
    return v.select("instrument", "date", (X.rank_pct(C("com_north"), "date") + X.rank_pct(C("com_flow"), "date")).alias("resonance"))
