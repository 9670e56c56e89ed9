"""Trading gates of a session: price limits, listing windows, suspensions; exit prices, market impact, cost-adjusted returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import sdiv
from tidemark.operators.portfolio import drawdowns, limit_prices

TICK = 0.005


def sessions(panel: DataFrame, share: Column, free_days: int, name: str = "instrument", date: str = "date") -> DataFrame:
    """panel (open, high, low, close, vol) with age, up, down, limit_up, limit_down, locked_up, locked_down, can_buy, can_sell.

    Limits follow from the last known close before the session. In the first free_days sessions of a name, and without a
    close before, there are none. Locked: high, low and limit are one price. A session without price or volume is suspended.
    """
    w = Window.partitionBy(name).orderBy(date)
    before = F.last("close", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = panel.withColumn("age", F.row_number().over(w)).withColumn("_before", before)
    up, down = limit_prices(F.col("_before"), share)
    free = (F.col("age") <= free_days) | F.col("_before").isNull()
    out = out.withColumn("up", F.when(~free, up)).withColumn("down", F.when(~free, down))
    no = F.lit(False)
    at_up, at_down = F.coalesce(F.col("open") >= F.col("up") - TICK, no), F.coalesce(F.col("open") <= F.col("down") + TICK, no)
    still = F.col("high") == F.col("low")
    trades = F.coalesce((F.col("open") > 0) & (F.col("vol") > 0), no)
    return out.drop("_before").select(
        "*", at_up.alias("limit_up"), at_down.alias("limit_down"), F.coalesce(still & (F.abs(F.col("high") - F.col("up")) < TICK), no).alias("locked_up"),
        F.coalesce(still & (F.abs(F.col("low") - F.col("down")) < TICK), no).alias("locked_down"), (trades & ~at_up).alias("can_buy"), (trades & ~at_down).alias("can_sell"),
    )


def exit_prices(panel: DataFrame, cost: Column, name: str = "instrument", date: str = "date") -> DataFrame:
    """name, last_date, price: where a name that leaves the market is closed: its last known close, else its cost, else 0."""
    last = panel.groupBy(name).agg(F.max(date).alias("last_date"), F.max_by("close", F.when(F.col("close").isNotNull(), F.col(date))).alias("_c"), F.max(cost).alias("_k"))
    return last.select(name, "last_date", F.coalesce("_c", "_k", F.lit(0.0)).alias("price"))


def impact_cost(value: Column, adv: Column, volatility: Column, flat: float = 0.001, scale: float = 0.1) -> Column:
    """The cost of a trade: a flat rate and a square root of its share of the mean amount."""
    return value * (flat + scale * volatility * F.sqrt(sdiv(value, adv)))


def net_returns(returns: DataFrame, gross: str, turnover: str, bps: float) -> DataFrame:
    """returns with net: gross less turnover times the cost; an unknown turnover costs nothing."""
    return returns.withColumn("net", F.col(gross) - F.coalesce(F.col(turnover), F.lit(0.0)) * (bps / 1e4))


def cost_summary(returns: DataFrame, turnover: str, per_year: float, *by: str) -> DataFrame:
    """by, annual_turnover, net_sharpe of net_returns()."""
    s = returns.groupBy(*by).agg(F.avg(turnover).alias("t"), F.avg("net").alias("m"), F.stddev_samp("net").alias("sd"))
    return s.select(*by, (F.col("t") * per_year).alias("annual_turnover"), (sdiv(F.col("m"), F.col("sd")) * per_year**0.5).alias("net_sharpe"))


def drawdown_spells(returns: DataFrame, value: str, order: str, *by: str) -> DataFrame:
    """by, duration (rows of the longest spell under water), peak_date (null if before the first row) and trough_date of the worst drawdown (its first)."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = drawdowns(returns, value, order, *by)
    d = d.withColumn("_run", F.sum((F.col("drawdown") >= 0).cast("int")).over(w)).withColumn("_top", F.max(F.when(F.col("nav") >= F.col("peak"), F.col(order))).over(w))
    longest = d.where("drawdown < 0").groupBy(*by, "_run").agg(F.count("*").alias("n")).groupBy(*by).agg(F.max("n").alias("duration"))
    worst = d.groupBy(*by).agg(F.min(F.struct("drawdown", F.col(order).alias("at"), "_top")).alias("w"))
    out = worst.join(longest, list(by), "left")
    return out.select(*by, F.coalesce("duration", F.lit(0)).cast("long").alias("duration"), F.col("w._top").alias("peak_date"), F.col("w.at").alias("trough_date"))


def period_win_rate(returns: DataFrame, value: str, order: str, unit: str, *by: str) -> DataFrame:
    """by, win_rate: the share of weeks or months with a gain."""
    from tidemark.operators.portfolio import compounded

    return compounded(returns, value, order, unit, *by).groupBy(*by).agg(F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"))


def adjusted(panel: DataFrame, prices: list[str], factor: str, name: str = "instrument", date: str = "date") -> DataFrame:
    """Prices times their factor over the name's last known factor; as they are where that is null or 0, or the row's factor is null."""
    w = Window.partitionBy(name).orderBy(date).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ratio = sdiv(F.col(factor), F.last(factor, ignorenulls=True).over(w))
    return panel.select(*[(F.col(c) * F.coalesce(ratio, F.lit(1.0))).alias(c) if c in prices else F.col(c) for c in panel.columns])


#: Ratings from worst to best, and labels that stand for no rating.
RATINGS = {"sell": 1, "reduce": 2, "hold": 3, "add": 4, "buy": 5}
NO_RATING = ("", "none", "not rated")


def rating_ordinal(label: Column) -> Column:
    """1 to 5; null for a label that isn't known."""
    folded, out = F.lower(F.trim(label)), F.lit(None).cast("int")
    for name, value in RATINGS.items():
        out = F.when(folded == name, value).otherwise(out)
    return out


def is_rating(label: Column) -> Column:
    return F.coalesce(~F.lower(F.trim(label)).isin(*NO_RATING), F.lit(False))


def disclosure_date(*dates: Column) -> Column:
    """The latest of the dates that are known."""
    return F.greatest(*dates)


def content_hash(*values: Column) -> Column:
    """A hash of a row's payload, to break ties alike in every run."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(v.cast("string"), F.lit("~")) for v in values]), 256)
