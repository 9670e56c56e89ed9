"""Queries of universes, trading gates, exits, costs and composites, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import cross_section as X
from tidemark.operators import portfolio as P
from tidemark.operators import trading as T
from tidemark.operators import universe as U
from tidemark.panel_queries import _PERF, _rank, book_returns
from tidemark.plans.catalog import CATALOG, COMPOSITES
from tidemark.plans.expression import compile_frame, compile_sql
from tidemark.queries import ORACLE_SQL, QUERIES, query, r6, rounded
from tidemark.sources.tables import WIDE_SQL, panel, table, wide_panel

C = F.col
_USED = {f: CATALOG[f] for f in sorted({f for weights in COMPOSITES.values() for f in weights})}


def _composite_sql() -> str:
    ctes, columns = compile_sql(_USED, "wide")
    listed = ", ".join(f"round({sql}, 12) AS {name}, -round({sql}, 12) AS n_{name}" for name, sql in columns.items())
    ranks = ", ".join(f"{_rank(f)} AS r_{f}" for f in sorted({(f if w >= 0 else "n_" + f) for weights in COMPOSITES.values() for f, w in weights.items()}))
    scores = ", ".join(f"{r6(' + '.join(f'r_{f if w >= 0 else chr(110) + chr(95) + f} * {abs(w)}' for f, w in weights.items()))} AS {name}" for name, weights in COMPOSITES.items())
    return f"WITH {WIDE_SQL},\n{ctes}, f AS (SELECT instrument, date, {listed} FROM _last), r AS (SELECT instrument, date, {ranks} FROM f) SELECT instrument, date::VARCHAR AS date, {scores} FROM r"


def factor_composites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All composites: each factor's rank is computed once, then weighted. Values equal to 12 decimals tie."""
    values = compile_frame(wide_panel(spark, sf_dir), _USED).select("instrument", "date", *[F.round(f, 12).alias(f) for f in _USED])
    signed = {(f, w >= 0) for weights in COMPOSITES.values() for f, w in weights.items()}
    ranks = values.select("instrument", "date", *[X.rank_pct(C(f) if up else -C(f), "date").alias(f"r{int(up)}_{f}") for f, up in sorted(signed)])
    total = lambda weights: sum((C(f"r{int(w >= 0)}_{f}") * abs(w) for f, w in weights.items()), F.lit(0.0))
    return rounded(ranks.select("instrument", "date", *[total(weights).alias(name) for name, weights in COMPOSITES.items()]))


QUERIES["factor_composites"] = factor_composites
ORACLE_SQL["factor_composites"] = _composite_sql()

_SESSIONS = """b AS (SELECT *, row_number() OVER w AS age, last_value(close IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM panel WINDOW w AS (PARTITION BY instrument ORDER BY date)),
l AS (SELECT *, CASE WHEN age > 5 THEN greatest(round((before * 1.1)::DECIMAL(18, 6), 2)::DOUBLE, 0.01) END AS up, CASE WHEN age > 5 THEN greatest(round((before * 0.9)::DECIMAL(18, 6), 2)::DOUBLE, 0.01) END AS down FROM (SELECT * FROM b WHERE before IS NOT NULL) UNION ALL SELECT *, NULL, NULL FROM b WHERE before IS NULL),
s AS (SELECT *, coalesce(open >= up - 0.005, false) AS limit_up, coalesce(open <= down + 0.005, false) AS limit_down, coalesce(high = low AND abs(high - up) < 0.005, false) AS locked_up, coalesce(high = low AND abs(low - down) < 0.005, false) AS locked_down, coalesce(open > 0 AND vol > 0, false) AS trades FROM l)"""


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.sessions(panel(spark, sf_dir), F.lit(0.1), 5)


@query("trading_gates", f"{_SESSIONS} SELECT instrument, date::VARCHAR AS date, age, {r6('up')} AS up, {r6('down')} AS down, limit_up, limit_down, locked_up, locked_down, trades AND NOT limit_up AS can_buy, trades AND NOT limit_down AS can_sell FROM s")
def trading_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sessions(spark, sf_dir).select("instrument", "date", "age", "up", "down", "limit_up", "limit_down", "locked_up", "locked_down", "can_buy", "can_sell")


_MASK = f"""{_SESSIONS}, a AS (SELECT *, CASE WHEN count(amount) OVER w >= 10 THEN avg(amount) OVER w END AS adv, coalesce(high = low AND vol > 0 AND (abs(high - up) <= 1e-4 OR abs(low - down) <= 1e-4 OR up IS NULL OR down IS NULL), false) AS word FROM s WINDOW w AS (PARTITION BY instrument ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
m AS (SELECT *, age <= 8 OR instrument % 17 = 0 OR close IS NULL OR coalesce(vol <= 0, true) OR word AS out, (instrument::VARCHAR LIKE '1%' OR instrument::VARCHAR LIKE '2%' OR instrument::VARCHAR LIKE '3%') AS board FROM a)"""


def _masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sessions(spark, sf_dir).withColumn("adv", U.mean_amount(C("amount"), 20, 10))
    word = U.one_word_limit(C("high"), C("low"), C("vol"), C("up"), C("down"))
    return s.withColumn("out", U.excluded(C("age") <= 8, C("instrument") % 17 == 0, P.suspended(), word)).withColumn("board", U.on_board(C("instrument").cast("string"), ["1", "2", "3"]))


@query("universe_mask", f"{_MASK} SELECT instrument, date::VARCHAR AS date, {r6('adv')} AS adv, out AS excluded, coalesce(board AND adv > 0, false) AND NOT out AND date >= DATE '1994-01-03' AS member FROM m")
def universe_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.universe_mask(_masked(spark, sf_dir), C("board") & (C("adv") > 0), C("out"), "1994-01-03").select("instrument", "date", "adv", C("out").alias("excluded"), "member")


@query("liquidity_rules", f"""{_MASK}, q AS (SELECT *, quantile_cont(adv, 0.2) OVER (PARTITION BY date) AS cut FROM m WHERE turnover IS NOT NULL AND adv IS NOT NULL)
SELECT instrument, date::VARCHAR AS date, row_number() OVER (PARTITION BY date ORDER BY turnover DESC, instrument) AS rank FROM q WHERE adv >= 20000 AND adv >= cut AND adv * 0.1 >= 30000.0 / 10 QUALIFY rank <= 10""")
def liquidity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.liquidity_rules(_masked(spark, sf_dir), "turnover", "adv", 10, 20_000, 0.2, 30_000, 0.1).select("instrument", "date", C("rank").cast("long").alias("rank"))


@query("eligible_names", f"""{_MASK}, p AS (SELECT *, {_rank('turnover')} AS pct FROM m) SELECT instrument, date::VARCHAR AS date FROM p WHERE NOT out AND board AND close <= 2000 AND mcap >= 500000 AND adv >= 10000 AND pct <= 0.9""")
def eligible_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _masked(spark, sf_dir).withColumn("pct", X.rank_pct(C("turnover"), "date"))
    return U.eligible(m, {"price": (C("close"), None, 2000.0), "size": (C("mcap"), 500_000.0, None), "adv": (C("adv"), 10_000.0, None), "turnover": (C("pct"), None, 0.9)}, [~C("out"), C("board")]).select("instrument", "date")


@query("exit_prices", f"x AS (SELECT 1) SELECT instrument, max(date)::VARCHAR AS last_date, {r6('coalesce(arg_max(close, date) FILTER (close IS NOT NULL), max(instrument * 1.5), 0.0)')} AS price FROM panel GROUP BY instrument")
def exit_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.exit_prices(panel(spark, sf_dir), C("instrument") * 1.5)


@query("impact_costs", f"{_MASK} SELECT instrument, date::VARCHAR AS date, {r6('10000.0 * (0.001 + 0.1 * 0.02 * sqrt(10000.0 / nullif(adv, 0)))')} AS cost FROM m")
def impact_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masked(spark, sf_dir).select("instrument", "date", T.impact_cost(F.lit(10_000.0), C("adv"), F.lit(0.02)).alias("cost"))


@query("adjusted_prices", f"""f AS (SELECT *, CASE WHEN day_no % 5 <> 0 THEN (1 + (day_no % 50) * 0.01)::DOUBLE END AS factor FROM panel), g AS (SELECT *, last_value(factor IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS newest FROM f)
SELECT instrument, date::VARCHAR AS date, {r6('close * coalesce(factor / nullif(newest, 0), 1.0)')} AS close, {r6('open * coalesce(factor / nullif(newest, 0), 1.0)')} AS open FROM g""")
def adjusted_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir).withColumn("factor", F.when(C("day_no") % 5 != 0, 1 + (C("day_no") % 50) * F.lit(0.01)).cast("double"))
    return T.adjusted(p, ["open", "close"], "factor").select("instrument", "date", "close", "open")


@query("cost_adjusted", f"""{_PERF}, t AS (SELECT *, CASE WHEN day(date) % 4 <> 0 THEN (day(date) % 10) / 10.0 END::DOUBLE AS turn FROM r), n AS (SELECT *, r - coalesce(turn, 0) * 0.002 AS net FROM t)
SELECT book, {r6('avg(turn) * 252')} AS annual_turnover, {r6('avg(net) / nullif(stddev_samp(net), 0) * sqrt(252)')} AS net_sharpe FROM n GROUP BY book""", with_panel=False)
def cost_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.dayofmonth("date")
    r = book_returns(spark, sf_dir).withColumn("turn", F.when(day % 4 != 0, (day % 10) / 10.0))
    return T.cost_summary(T.net_returns(r, "r", "turn", 20.0), "turn", 252.0, "book")


@query("drawdown_spells", f"""{_PERF}, k AS (SELECT *, greatest(max(nav) OVER w, 1.0) AS peak, sum((dd >= 0)::INTEGER) OVER w AS run FROM d WINDOW w AS (PARTITION BY book ORDER BY date)), t AS (SELECT *, max(CASE WHEN nav >= peak THEN date END) OVER (PARTITION BY book ORDER BY date) AS top FROM k),
u AS (SELECT book, max(n) AS duration FROM (SELECT book, run, count(*) AS n FROM t WHERE dd < 0 GROUP BY ALL) GROUP BY book), z AS (SELECT book, arg_min({{'a': date, 'b': top}}, dd) AS z FROM (SELECT * FROM t ORDER BY date) GROUP BY book)
SELECT z.book, coalesce(duration, 0)::BIGINT AS duration, z.z.b::VARCHAR AS peak_date, z.z.a::VARCHAR AS trough_date FROM z LEFT JOIN u ON z.book = u.book""", with_panel=False)
def drawdown_spells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.drawdown_spells(book_returns(spark, sf_dir), "r", "date", "book")


for _unit in ("week", "month"):
    @query(f"{_unit}ly_win_rate", f"{_PERF}, c AS (SELECT book, date_trunc('{_unit}', date) AS period, product(1 + r) - 1 AS ret FROM r GROUP BY ALL) SELECT book, {r6('avg((ret > 0)::INTEGER)')} AS win_rate FROM c GROUP BY book", with_panel=False)
    def win_rate(spark: SparkSession, sf_dir: str, unit: str = _unit) -> DataFrame:
        return T.period_win_rate(book_returns(spark, sf_dir), "r", "date", unit, "book")


_LABELS = ["Buy", " add", "HOLD ", "reduce", "Sell", "Not Rated", "outlook"]


@query("ratings", f"""WITH l AS (SELECT o_orderkey, {_LABELS}[o_orderkey % 8 + 1] AS label, o_orderdate::DATE AS a, CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderdate + INTERVAL 9 DAY)::DATE END AS f, o_totalprice AS now, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders)
SELECT o_orderkey, CASE lower(trim(label)) WHEN 'sell' THEN 1 WHEN 'reduce' THEN 2 WHEN 'hold' THEN 3 WHEN 'add' THEN 4 WHEN 'buy' THEN 5 END::INTEGER AS ordinal, coalesce(lower(trim(label)) NOT IN ('', 'none', 'not rated'), false) AS rated, greatest(a, f)::VARCHAR AS disclosed,
 sha256(o_orderkey::VARCHAR || '|' || coalesce(label, '~')) AS hash, {r6('(now - before) * 100 / nullif(abs(before), 0)')} AS change FROM l""", with_panel=False)
def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    o, key = table(spark, sf_dir, "orders"), C("o_orderkey")
    label = F.get(F.array(*map(F.lit, _LABELS)), (key % 8).cast("int"))
    o = o.withColumn("label", label).withColumn("before", F.lag("o_totalprice").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    day = F.to_date("o_orderdate")
    return o.select("o_orderkey", T.rating_ordinal(C("label")).alias("ordinal"), T.is_rating(C("label")).alias("rated"), T.disclosure_date(day, F.when(key % 3 != 0, F.date_add(day, 9))).alias("disclosed"),
                    T.content_hash(key, C("label")).alias("hash"), S.percent_change(C("o_totalprice"), C("before")).alias("change"))
