"""Queries of the selection operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import evaluation as E
from tidemark.operators import portfolio as P
from tidemark.operators import selection as K
from tidemark.panel_queries import _BUCKETS, _IC, _LONG, _PERF, _SIGNALS, _TOP, RANK, _rank, book_returns, signals
from tidemark.plans.expression import compile_frame, compile_sql
from tidemark.queries import query, r6
from tidemark.sources.tables import panel, table

C = F.col
_SUMMARY = f"{_BUCKETS}, qs AS (SELECT factor, bucket, avg(mean_return) * 52 AS annual_return, stddev_samp(mean_return) * sqrt(52) AS volatility, avg(mean_return) / nullif(stddev_samp(mean_return), 0) * sqrt(52) AS sharpe FROM q GROUP BY ALL)"


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.quantile_summary(E.quantile_returns(signals(spark, sf_dir), "label", 5), 52.0)


@query("quantile_summary", f"{_SUMMARY} SELECT factor, bucket::INTEGER AS bucket, {r6('annual_return')} AS annual_return, {r6('volatility')} AS volatility, {r6('sharpe')} AS sharpe FROM qs")
def quantile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, sf_dir)


@query("quantile_shape", f"""{_SUMMARY}, d AS (SELECT factor, bucket, annual_return, annual_return - lag(annual_return) OVER (PARTITION BY factor ORDER BY bucket) AS d, {RANK.format(x='annual_return', p='factor')} AS r FROM qs),
g AS (SELECT factor, string_agg(CASE WHEN d > 1e-12 THEN '+' WHEN d < -1e-12 THEN '-' WHEN d IS NOT NULL THEN '0' END, '' ORDER BY bucket) AS signs, count(*) AS n, covar_samp(bucket, r) / nullif(stddev_samp(bucket) * stddev_samp(r), 0) AS c FROM d GROUP BY factor)
SELECT factor, signs, CASE WHEN regexp_full_match(signs, '\\++') THEN 'monotonic_up' WHEN regexp_full_match(signs, '-+') THEN 'monotonic_down' WHEN regexp_full_match(signs, '\\++-') THEN 'top_reversal' WHEN regexp_full_match(signs, '-\\++') THEN 'bottom_reversal'
 WHEN regexp_full_match(signs, '-+\\++') THEN 'U_shape' WHEN regexp_full_match(signs, '\\++-+') THEN 'inverted_U' ELSE 'irregular' END AS shape, {r6("greatest(len(replace(replace(signs, '-', ''), '0', '')), len(replace(replace(signs, '+', ''), '0', ''))) / len(signs)")} AS dominant, {r6('c')} AS monotonicity FROM g WHERE n >= 3""")
def quantile_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.quantile_shape(_summary(spark, sf_dir)).where("shape IS NOT NULL")


_GROUPS = f"{_LONG}, o AS (SELECT *, row_number() OVER (PARTITION BY factor, date ORDER BY value, instrument) AS r, count(*) OVER (PARTITION BY factor, date) AS n FROM long WHERE value IS NOT NULL), gr AS (SELECT *, CASE WHEN n > 1 THEN greatest(1, ((r - 1) * 10 + n - 2) // (n - 1)) ELSE 1 END AS bucket FROM o)"


@query("top_group_excess", f"{_GROUPS}, e AS (SELECT factor, date, avg(label) FILTER (bucket = 10) - avg(label) AS excess FROM gr WHERE label IS NOT NULL GROUP BY ALL) SELECT factor, date::VARCHAR AS date, {r6('excess')} AS excess FROM e WHERE excess IS NOT NULL")
def top_group_excess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.top_excess(K.equal_count_groups(signals(spark, sf_dir), 10, "instrument", "factor", "date"), "label", 10)


@query("ic_by_group", f"""{_LONG}, gp AS (SELECT *, instrument % 4 AS grp FROM pairs), rk AS (SELECT *, {RANK.format(x='value', p='factor, grp, date')} AS rx, {RANK.format(x='label', p='factor, grp, date')} AS ry FROM gp),
i AS (SELECT factor, grp, date, covar_samp(rx, ry) / nullif(stddev_samp(rx) * stddev_samp(ry), 0) AS ic FROM rk GROUP BY ALL HAVING count(*) >= 10) SELECT factor, grp, {r6('avg(ic)')} AS mean_ic, count(ic) AS days FROM i GROUP BY factor, grp""")
def ic_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.ic_by_group(signals(spark, sf_dir).withColumn("grp", C("instrument") % 4), "label", "grp", 10)


def _wide_sql() -> str:
    ctes, columns = compile_sql(_SIGNALS | {"label": "Ref($close, -4) / $close - 1"}, "panel")
    return f"{ctes},\nwide AS (SELECT instrument, date, {', '.join(f'{sql} AS {name}' for name, sql in columns.items())} FROM _last)"


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compile_frame(panel(spark, sf_dir), _SIGNALS | {"label": "Ref($close, -4) / $close - 1"}).select("instrument", "date", *_SIGNALS, "label")


@query("marginal_ic", f"""{_wide_sql()}, b AS (SELECT *, CASE WHEN turn IS NOT NULL AND rev IS NOT NULL THEN turn END AS a, CASE WHEN turn IS NOT NULL AND rev IS NOT NULL THEN rev END AS z FROM wide),
m AS (SELECT date, avg(a) AS ma, avg(z) AS mz, covar_samp(a, z) / nullif(var_samp(z), 0) AS beta, count(a) AS n FROM b GROUP BY date), v AS (SELECT b.date, label, CASE WHEN n >= 10 THEN a - ma - beta * (z - mz) END AS value FROM b JOIN m ON b.date = m.date),
p AS (SELECT * FROM v WHERE value IS NOT NULL AND label IS NOT NULL) SELECT date::VARCHAR AS date, {r6('covar_samp(value, label) / nullif(stddev_samp(value) * stddev_samp(label), 0)')} AS ic, count(*) AS n FROM p GROUP BY date HAVING count(*) >= 20""")
def marginal_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.ic_series(K.marginal(_wide(spark, sf_dir), "turn", "rev"), "label").select("date", "ic", "n")


_NAMES = list(_SIGNALS)
_CORR = f"""{_wide_sql()}, whole AS (SELECT * FROM wide WHERE {' AND '.join(f'{f} IS NOT NULL' for f in _NAMES)}), rk AS (SELECT date, {', '.join(f'{_rank(f)} AS {f}' for f in _NAMES)} FROM whole),
cr AS ({' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, date, covar_samp({a}, {b}) / nullif(stddev_samp({a}) * stddev_samp({b}), 0) AS c FROM rk GROUP BY date" for i, a in enumerate(_NAMES) for b in _NAMES[i + 1:])}),
pair AS (SELECT a, b, avg(c) AS c FROM cr GROUP BY a, b)"""


@query("factor_correlations", f"{_CORR} SELECT a, b, {r6('c')} AS correlation FROM pair")
def factor_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.factor_correlations(_wide(spark, sf_dir), _NAMES)


@query("factor_clusters", f"""{_CORR}, e AS (SELECT a, b FROM pair WHERE abs(c) >= 0.02), n AS (SELECT unnest({_NAMES}) AS f), s AS (SELECT f AS u, f AS v FROM n UNION SELECT a, b FROM e UNION SELECT b, a FROM e),
s2 AS (SELECT DISTINCT x.u, y.v FROM s x JOIN s y ON x.v = y.u) SELECT u AS factor, min(v) AS "cluster" FROM s2 GROUP BY u""")
def factor_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.clusters(E.factor_correlations(_wide(spark, sf_dir), _NAMES), _NAMES, 0.02)


@query("uncorrelated_factors")
def uncorrelated_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    strength = E.ic_summary(E.ic_series(signals(spark, sf_dir), "label"), "factor")
    taken = K.uncorrelated(strength, E.factor_correlations(_wide(spark, sf_dir), _NAMES), 0.7)
    return spark.createDataFrame(list(enumerate(taken)), "place int, factor string")


@query("bootstrap_interval", f"""{_PERF}, h AS (SELECT book, list(r ORDER BY date) AS x, avg(r) AS mean, count(r) AS n FROM r GROUP BY book), drawn AS (SELECT *, unnest(range(0, 200)) AS draw FROM h WHERE n >= 20),
bl AS (SELECT *, unnest(range(0, ceil(n / 20)::BIGINT)) AS b FROM drawn), st AS (SELECT *, ('0x' || substr(md5('42:' || draw || ':' || b), 1, 12))::BIGINT % (n - 20 + 1) AS s FROM bl),
m AS (SELECT book, draw, any_value(mean) AS mean, any_value(n) AS n, sum(list_sum(list_slice(x, s + 1, s + least(20, n - b * 20)))) / any_value(n) AS m FROM st GROUP BY book, draw)
SELECT book, {r6('any_value(mean)')} AS mean, {r6('quantile_cont(m, 0.025)')} AS ci_low, {r6('quantile_cont(m, 0.975)')} AS ci_high, any_value(n) AS n FROM m GROUP BY book""", with_panel=False)
def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.block_bootstrap(book_returns(spark, sf_dir), "r", "date", 20, 200, "book")


@query("family_capped_weights", f"""{_TOP}, m AS (SELECT date, instrument, turnover AS w, instrument % 4 AS family FROM top), f AS (SELECT date, family, sum(w) AS s, CASE family WHEN 0 THEN 0.3 WHEN 1 THEN 0.2 END::DOUBLE AS cap FROM m GROUP BY ALL),
o AS (SELECT *, coalesce(s * (1 - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / nullif(sum(s) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) > cap, false) AS over FROM f WINDOW w AS (PARTITION BY date ORDER BY s / cap DESC NULLS LAST, family)),
g AS (SELECT *, sum(s) FILTER (NOT over) OVER (PARTITION BY date) AS free, coalesce(sum(cap) FILTER (over) OVER (PARTITION BY date), 0) AS held FROM o), h AS (SELECT *, CASE WHEN over THEN cap ELSE s * (1 - held) / nullif(free, 0) END AS share FROM g),
k AS (SELECT *, share / nullif(sum(share) OVER (PARTITION BY date), 0) AS part FROM h) SELECT m.date::VARCHAR AS date, instrument, m.family, {r6('w * part / nullif(s, 0)')} AS weight FROM m JOIN k ON m.date = k.date AND m.family = k.family""")
def family_capped_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = P.top_by(panel(spark, sf_dir), "turnover", 9).select("date", "instrument", C("turnover").alias("weight"), (C("instrument") % 4).alias("family"))
    return K.family_capped(top, "weight", "family", F.when(C("family") == 0, 0.3).when(C("family") == 1, 0.2)).select("date", "instrument", "family", "weight")


_CODES = ["300", "301", "688", "689", "430", "920", "600", "000"]


@query("limit_shares", f"""WITH c AS (SELECT o_orderkey, {_CODES}[o_orderkey % 8 + 1] || '123' || CASE WHEN o_orderkey % 5 = 0 THEN '.BJ' ELSE '.SZ' END AS code, o_orderkey % 11 = 0 AS st, (o_orderdate + INTERVAL 22 YEAR)::DATE AS d FROM orders)
SELECT o_orderkey, CASE WHEN st THEN 0.05 WHEN code[:3] IN ('300', '301') THEN CASE WHEN d >= DATE '2020-08-24' THEN 0.2 ELSE 0.1 END WHEN code[:3] IN ('688', '689') THEN CASE WHEN d >= DATE '2019-07-22' THEN 0.2 ELSE 0.1 END
 WHEN code LIKE '%.BJ' OR code[:2] IN ('43', '83', '87', '88', '92') THEN 0.3 ELSE 0.1 END::DOUBLE AS share FROM c""", with_panel=False)
def limit_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = C("o_orderkey")
    code = F.concat(F.element_at(F.array(*map(F.lit, _CODES)), (key % 8 + 1).cast("int")), F.lit("123"), F.when(key % 5 == 0, ".BJ").otherwise(".SZ"))
    return table(spark, sf_dir, "orders").select("o_orderkey", K.limit_share(code, key % 11 == 0, F.to_date(F.add_months("o_orderdate", 264))).alias("share"))


@query("corporate_actions", """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, (l_quantity * 100)::BIGINT AS shares, l_extendedprice / l_quantity / 100 AS cost FROM lineitem), a AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_size / 100 END AS cash, CASE WHEN p_size % 4 = 0 THEN p_size / 90 END AS bonus FROM part),
j AS (SELECT *, floor(shares * coalesce(bonus, 0))::BIGINT AS more FROM p LEFT JOIN a ON l_partkey = p_partkey)
SELECT l_orderkey, l_linenumber, shares + more AS shares, round(cost * shares / (shares + more) + 3.3e-10, 6) + 0.0 AS avg_cost, round(coalesce(cash, 0) * shares + 3.3e-10, 6) + 0.0 AS dividend FROM j""", with_panel=False)
def corporate_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", C("l_partkey").alias("name"), (C("l_quantity") * 100).cast("long").alias("shares"), (C("l_extendedprice") / C("l_quantity") / 100).alias("avg_cost"))
    paid = table(spark, sf_dir, "part").select(C("p_partkey").alias("name"), F.when(C("p_size") % 3 == 0, C("p_size") / 100).alias("cash"), F.when(C("p_size") % 4 == 0, C("p_size") / 90).alias("bonus"))
    return K.with_actions(held, paid, ["name"]).drop("name")
