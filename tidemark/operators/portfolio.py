"""Universes, schedules, weights, the order simulator and return metrics."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import round_half_up, sdiv


def suspended() -> Column:
    return F.coalesce(F.col("vol") <= 0, F.lit(True)) | F.col("close").isNull()


def month_ends(panel: DataFrame, date: str = "date") -> DataFrame:
    """The last date of each month."""
    return panel.groupBy(F.year(date).alias("y"), F.month(date).alias("m")).agg(F.max(date).alias(date)).select(date)


def top_by(panel: DataFrame, score: str, k: int, date: str = "date", name: str = "instrument") -> DataFrame:
    """The k highest scores of each date with their rank; ties by name."""
    w = Window.partitionBy(date).orderBy(F.desc(score), name)
    return panel.where(F.col(score).isNotNull()).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def monthly_base(panel: DataFrame, score: str, k: int, date: str = "date", name: str = "instrument") -> DataFrame:
    """date, name: members chosen at each month's last date by score, held until the next choice (none before the first)."""
    chosen = top_by(panel.join(month_ends(panel, date), date, "left_semi"), score, k, date, name).select(F.col(date).alias("_chosen"), name)
    dates = panel.select(date).distinct().crossJoin(F.broadcast(month_ends(panel, date).select(F.col(date).alias("_c")).agg(F.sort_array(F.collect_list("_c")).alias("_all"))))
    held = dates.select(date, F.array_max(F.filter("_all", lambda c: c <= F.col(date))).alias("_chosen")).where("_chosen IS NOT NULL")
    return held.join(chosen, "_chosen").select(date, name)


def equal_weights(chosen: DataFrame, cap: float = 1.0, date: str = "date") -> DataFrame:
    return chosen.withColumn("weight", F.least(1 / F.count("*").over(Window.partitionBy(date)), F.lit(cap)))


def tiered_weights(chosen: DataFrame, tiers: tuple[float, ...] = (2.0, 1.25, 0.75), date: str = "date") -> DataFrame:
    """Weights by third of the rank, normalised by date."""
    n = F.count("*").over(Window.partitionBy(date))
    third = F.least(F.floor((F.col("rank") - 1) * len(tiers) / n), F.lit(len(tiers) - 1)).cast("int")
    raw = chosen.withColumn("_t", F.element_at(F.array(*map(F.lit, tiers)), third + 1))
    return raw.withColumn("weight", F.col("_t") / F.sum("_t").over(Window.partitionBy(date))).drop("_t")


def blended(fast: DataFrame, slow: DataFrame, share: float, keys: list[str]) -> DataFrame:
    """share of one weight table and the rest of another."""
    both = fast.select(*keys, F.col("weight").alias("_a")).join(slow.select(*keys, F.col("weight").alias("_b")), keys, "full")
    return both.select(*keys, (share * F.coalesce("_a", F.lit(0.0)) + (1 - share) * F.coalesce("_b", F.lit(0.0))).alias("weight"))


def limit_prices(previous: Column, share: Column) -> tuple[Column, Column]:
    """(up, down) limits of a session, half-up to ticks of 0.01, never below one tick."""
    up = round_half_up(previous * (1 + share))
    return F.greatest(up, F.lit(0.01)), F.greatest(round_half_up(previous * (1 - share)), F.lit(0.01))


@dataclass(frozen=True)
class Costs:
    """Rates of a fill: commission (at least `least`), transfer fee, and stamp tax on sales; lots and participation."""

    commission: float = 0.0003
    least: float = 5.0
    transfer: float = 0.00001
    stamp: float = 0.0005
    slippage: float = 0.001
    lot: int = 100
    participation: float = 0.25

    def buy(self, value: float) -> float:
        return max(self.commission * value, self.least) + self.transfer * value

    def sell(self, value: float) -> float:
        return self.buy(value) + self.stamp * value


def buy_cost(value: Column, c: Costs = Costs()) -> Column:
    return F.greatest(value * c.commission, F.lit(c.least)) + value * c.transfer


def sell_cost(value: Column, c: Costs = Costs()) -> Column:
    return buy_cost(value, c) + value * c.stamp


def simulate(schedule: DataFrame, prices: DataFrame, cash: float = 1e6, costs: Costs = Costs()) -> DataFrame:
    """scenario, date, equity, cash, positions, traded: one sequential fold for each scenario.

    schedule: scenario, date, instrument, weight (targets of rebalance dates); prices: date, instrument, open, close,
    vol. Fills are at the open moved by slippage, sales before purchases, in lots, at most a share of the volume; shares
    bought today can't be sold today; a name without a price or volume doesn't trade and is valued at its last price.
    With columns up and down in prices (null for no limit), nothing is bought at an open on the upper limit or sold at one
    on the lower. A name is closed at its last price, less costs, on the first date after its last row; with no price
    known it is worth 0.
    Scenarios run in parallel; a scenario's state is its positions, so a fold holds one scenario's schedule and prices.
    """
    limits = [c for c in ("up", "down") if c in prices.columns]
    names = schedule.select("scenario", "instrument").distinct()
    held = prices.select("date", "instrument", "open", "close", "vol", *limits).join(names, "instrument").join(schedule.select("scenario", "date", "instrument", "weight"), ["scenario", "date", "instrument"], "left")

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        money, shares, last, out = cash, {}, {}, []
        ends = frame.groupby("instrument")["date"].max().to_dict()
        for date, day in frame.sort_values(["date", "instrument"]).groupby("date", sort=True):
            day = day.set_index("instrument")
            last |= {k: v for k, v in day["close"].items() if v == v}
            live = day[(day["open"] > 0) & (day["vol"] > 0)]
            traded = 0.0
            for k in sorted(k for k in shares if ends[k] < date):
                value = shares.pop(k) * last.get(k, 0.0)
                money += value - (costs.sell(value) if value else 0.0)
                traded += value
            shut_up = set(live.index[live["open"] >= live["up"] - 0.005]) if "up" in live else set()
            shut_down = set(live.index[live["open"] <= live["down"] + 0.005]) if "down" in live else set()
            if day["weight"].notna().any():
                target = day["weight"].dropna().to_dict()
                worth = money + sum(n * last.get(k, 0.0) for k, n in shares.items())
                wanted = {k: int(worth * target.get(k, 0.0) / live.at[k, "open"] // costs.lot * costs.lot) for k in live.index if k in target or k in shares}
                for k in sorted(wanted):
                    surplus = shares.get(k, 0) - wanted[k]
                    if surplus > 0 and k not in shut_down:
                        n = min(surplus, int(live.at[k, "vol"] * costs.lot * costs.participation))
                        value = n * max(live.at[k, "open"] * (1 - costs.slippage), 0.01)
                        if n > 0:
                            money += value - costs.sell(value)
                            traded += value
                            shares[k] -= n
                for k in sorted(wanted):
                    short = wanted[k] - shares.get(k, 0)
                    if short > 0 and k not in shut_up:
                        price = live.at[k, "open"] * (1 + costs.slippage)
                        n = min(short, int(live.at[k, "vol"] * costs.lot * costs.participation)) // costs.lot * costs.lot
                        while n > 0 and n * price + costs.buy(n * price) > money:
                            n -= costs.lot
                        if n > 0:
                            money -= n * price + costs.buy(n * price)
                            traded += n * price
                            shares[k] = shares.get(k, 0) + n
                shares = {k: n for k, n in shares.items() if n}
            out.append((frame["scenario"].iloc[0], date, money + sum(n * last.get(k, 0.0) for k, n in shares.items()), money, len(shares), traded))
        return pd.DataFrame(out, columns=["scenario", "date", "equity", "cash", "positions", "traded"])

    return held.groupBy("scenario").applyInPandas(fold, "scenario string, date date, equity double, cash double, positions int, traded double")


def drawdowns(returns: DataFrame, value: str, order: str, *by: str) -> DataFrame:
    """returns with nav (compounded), peak and drawdown."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    nav = returns.withColumn("nav", F.product(1 + F.coalesce(F.col(value), F.lit(0.0))).over(w))
    return nav.withColumn("peak", F.greatest(F.max("nav").over(w), F.lit(1.0))).withColumn("drawdown", F.col("nav") / F.col("peak") - 1)


def performance(returns: DataFrame, value: str, order: str, per_year: float, *by: str) -> DataFrame:
    """Annualised return and volatility, Sharpe, Sortino, worst drawdown, Calmar and win rate."""
    d = drawdowns(returns, value, order, *by)
    down = F.sqrt(F.avg(F.pow(F.least(F.col(value), F.lit(0.0)), F.lit(2))))
    out = d.groupBy(*by).agg(
        F.count(value).alias("n"), F.max_by("nav", order).alias("growth"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), down.alias("down"),
        F.min("drawdown").alias("max_drawdown"), F.avg((F.col(value) > 0).cast("double")).alias("win_rate"),
    )
    annual = F.pow(F.col("growth"), per_year / F.col("n")) - 1
    year = per_year**0.5
    return out.select(
        *by, "n", (F.col("growth") - 1).alias("total_return"), annual.alias("annual_return"), (F.col("sd") * year).alias("volatility"),
        (sdiv(F.col("mean"), F.col("sd")) * year).alias("sharpe"), (sdiv(F.col("mean"), F.col("down")) * year).alias("sortino"), "max_drawdown",
        sdiv(annual, -F.col("max_drawdown")).alias("calmar"), "win_rate",
    )


def capped_weights(chosen: DataFrame, weight: str, cap: float, date: str = "date", name: str = "instrument") -> DataFrame:
    """weight normalised by date, none above cap: the excess goes to the others in proportion, until none is above.

    The capped names are the largest ones, so one sorted pass finds them: a name is capped if its share of what is left
    after all larger ones are is still above cap. Null on dates with too few names for the cap; negatives count as 0.
    """
    w = Window.partitionBy(date).orderBy(F.desc("_w"), name)
    rest = F.sum("_w").over(w.rowsBetween(0, Window.unboundedFollowing))
    out = chosen.withColumn("_w", F.greatest(F.coalesce(F.col(weight), F.lit(0.0)), F.lit(0.0)))
    out = out.withColumn("_rank", F.row_number().over(w)).withColumn("_rest", rest)
    out = out.withColumn("_over", sdiv(F.col("_w") * (1 - (F.col("_rank") - 1) * cap), F.col("_rest")) > cap)
    day = Window.partitionBy(date)
    out = out.withColumn("_capped", F.sum(F.col("_over").cast("int")).over(day)).withColumn("_free", F.sum(F.when(~F.col("_over"), F.col("_w"))).over(day))
    share = F.when(F.col("_over"), F.lit(cap)).otherwise(sdiv(F.col("_w") * (1 - F.col("_capped") * cap), F.col("_free")))
    return out.withColumn(weight, F.when(F.count("*").over(day) * cap >= 1 - 1e-12, share)).drop("_w", "_rank", "_rest", "_over", "_capped", "_free")


def relative_performance(returns: DataFrame, value: str, benchmark: str, per_year: float, *by: str) -> DataFrame:
    """Against a benchmark, over rows that have both: tracking error, information ratio, beta and annual alpha."""
    both = returns.where(F.col(value).isNotNull() & F.col(benchmark).isNotNull()).withColumn("_e", F.col(value) - F.col(benchmark))
    s = both.groupBy(*by).agg(F.count("*").alias("n"), F.avg("_e").alias("e"), F.stddev_samp("_e").alias("se"), F.avg(value).alias("m"), F.avg(benchmark).alias("mb"), sdiv(F.covar_samp(value, benchmark), F.var_samp(benchmark)).alias("beta"))
    year = per_year**0.5
    return s.select(*by, "n", (F.col("se") * year).alias("tracking_error"), (sdiv(F.col("e"), F.col("se")) * year).alias("information_ratio"), "beta", ((F.col("m") - F.col("beta") * F.col("mb")) * per_year).alias("alpha"))


def payoff(returns: DataFrame, value: str, *by: str, tail: float = 0.05, filled: bool = True) -> DataFrame:
    """Profit factor (infinite without a loss), mean gain over mean loss (0 without either) and the ratio of the tails.

    Unless filled, a ratio that lacks a gain or a loss is null, and a lower tail of 0 divides as doubles do.
    """
    r = F.col(value)
    gain, loss = F.when(r > 0, r), F.when(r < 0, -r)
    s = returns.groupBy(*by).agg(F.sum(gain).alias("g"), F.sum(loss).alias("l"), F.avg(gain).alias("mg"), F.avg(loss).alias("ml"), F.percentile(r, F.lit(1 - tail)).alias("hi"), F.percentile(r, F.lit(tail)).alias("lo"))
    if not filled:
        hi, lo = F.abs("hi"), F.abs("lo")
        tails = F.when(lo != 0, sdiv(hi, lo)).when(lo == 0, F.when(hi == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf"))))
        return s.select(*by, sdiv(F.col("g"), F.col("l")).alias("profit_factor"), sdiv(F.col("mg"), F.col("ml")).alias("profit_loss_ratio"), tails.alias("tail_ratio"))
    factor = F.when(F.col("l") > 0, F.coalesce("g", F.lit(0.0)) / F.col("l")).when(F.col("g") > 0, F.lit(float("inf"))).otherwise(0.0)
    return s.select(*by, factor.alias("profit_factor"), F.coalesce(sdiv(F.col("mg"), F.col("ml")), F.lit(0.0)).alias("profit_loss_ratio"), F.coalesce(sdiv(F.abs("hi"), F.abs("lo")), F.lit(0.0)).alias("tail_ratio"))


def compounded(returns: DataFrame, value: str, order: str, unit: str, *by: str) -> DataFrame:
    """Returns compounded by calendar unit (week, month, year): period (its first date), ret."""
    return returns.groupBy(*by, F.to_date(F.date_trunc(unit, order)).alias("period")).agg((F.product(1 + F.coalesce(F.col(value), F.lit(0.0))) - 1).alias("ret"))


def rolling_performance(returns: DataFrame, value: str, order: str, rows: int, per_year: float, *by: str) -> DataFrame:
    """returns with rolling return, volatility and Sharpe; null until rows values are there."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(1 - rows, 0)
    full = F.count(value).over(w) == rows
    mean, sd = F.avg(value).over(w), F.stddev_samp(value).over(w)
    return returns.select(
        "*", F.when(full, F.product(1 + F.col(value)).over(w) - 1).alias("rolling_return"), F.when(full, sd * per_year**0.5).alias("rolling_volatility"),
        F.when(full, sdiv(mean, sd) * per_year**0.5).alias("rolling_sharpe"),
    )
