"""What a schedule of holdings did: spells of names, their trades, changes at each rebalance, statistics of all trades.

members: date (of a rebalance) and name, one row for each name held from that date to the next rebalance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import sdiv


def calendar(rows: DataFrame, date: str = "date") -> DataFrame:
    """date, pos (from 1), next: a row for each date, so the window without a partition is as long as the calendar."""
    w = Window.orderBy(date)
    return rows.select(date).distinct().select(date, F.row_number().over(w).alias("pos"), F.lead(date).over(w).alias("next"))


def spells(members: DataFrame, date: str = "date", name: str = "instrument") -> DataFrame:
    """name, entry, exit: runs of consecutive rebalances that hold a name; exit is the first without it, null if there is none."""
    placed = members.select(date, name).distinct().join(calendar(members, date), date)
    run = F.col("pos") - F.row_number().over(Window.partitionBy(name).orderBy("pos"))
    return placed.withColumn("_run", run).groupBy(name, "_run").agg(F.min(date).alias("entry"), F.max_by("next", "pos").alias("exit")).drop("_run")


def trade_returns(held: DataFrame, panel: DataFrame, price: str, buy: float, sell: float, date: str = "date", name: str = "instrument") -> DataFrame:
    """name, entry, exit, ret (less the rates of both sides), hold_days (calendar dates, both ends) of spells that ended.

    Spells without a price at either end, or with an entry price not above 0, are left out.
    """
    known = panel.where(F.col(price).isNotNull()).select(name, date, price)
    days = calendar(panel, date)
    out = held.where("exit IS NOT NULL")
    for side in ("entry", "exit"):
        out = out.join(known.select(name, F.col(date).alias(side), F.col(price).alias(f"_{side}")), [name, side]).join(days.select(F.col(date).alias(side), F.col("pos").alias(f"_at_{side}")), side)
    ret = F.col("_exit") / F.col("_entry") - 1 - buy - sell
    return out.where("_entry > 0").select(name, "entry", "exit", ret.alias("ret"), (F.col("_at_exit") - F.col("_at_entry") + 1).alias("hold_days"))


def changes(members: DataFrame, panel: DataFrame, date: str = "date", name: str = "instrument") -> DataFrame:
    """date, held, bought, sold, executable of each rebalance.

    Executable: purchases of names not at limit_up and sales of names not at limit_down; a name without a row isn't.
    """
    runs = spells(members, date, name)
    bought = runs.select(F.col("entry").alias(date), name, F.lit(True).alias("_buy"))
    sold = runs.where("exit IS NOT NULL").select(F.col("exit").alias(date), name, F.lit(False).alias("_buy"))
    orders = bought.union(sold).join(panel.select(date, name, "limit_up", "limit_down"), [date, name], "left")
    free = F.coalesce(~F.when(F.col("_buy"), F.col("limit_up")).otherwise(F.col("limit_down")), F.lit(False))
    counts = orders.groupBy(date).agg(F.count_if("_buy").alias("bought"), F.count_if(~F.col("_buy")).alias("sold"), F.count_if(free).alias("executable"))
    held = members.groupBy(date).agg(F.count_distinct(name).alias("held"))
    return held.join(counts, date, "left").select(date, "held", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("bought", "sold", "executable")])


def positions(members: DataFrame, panel: DataFrame, date: str = "date", name: str = "instrument") -> DataFrame:
    """date, name of every date of the panel: what the last rebalance up to then holds."""
    chosen = members.select(date).distinct().withColumn("_r", F.col(date))
    so_far = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, 0)  # as long as the calendar
    days = panel.select(date).distinct().join(chosen, date, "left").withColumn("_r", F.last("_r", ignorenulls=True).over(so_far))
    return days.join(members.select(F.col(date).alias("_r"), name).distinct(), "_r").select(date, name)


def trading_statistics(members: DataFrame, panel: DataFrame, price: str, per_year: float, buy: float = 0.0005, sell: float = 0.0015, date: str = "date", name: str = "instrument") -> DataFrame:
    """One row: mean names held, changes, trades with their mean days, return, gain, loss and win rate, yearly turnover,
    shares of suspended holdings, of executable orders and of dates with a position. 0 where nothing is there to count.

    panel: date, name, price, vol, limit_up, limit_down. A holding without volume or without a row is suspended.
    """
    traded = trade_returns(spells(members, date, name), panel, price, buy, sell, date, name)
    r = F.col("ret")
    a = traded.agg(
        F.count("*").alias("trades"), F.avg("hold_days").alias("hold_days"), F.avg(r).alias("mean_return"), F.avg(F.when(r > 0, r)).alias("mean_gain"),
        F.avg(F.when(r < 0, r)).alias("mean_loss"), F.avg((r > 0).cast("double")).alias("win_rate"),
    )
    b = changes(members, panel, date, name).agg(F.avg("held").alias("held"), F.sum(F.col("bought") + F.col("sold")).alias("changes"), F.sum("executable").alias("_ok"))
    kept = positions(members, panel, date, name).join(panel.select(date, name, "vol"), [date, name], "left")
    halted = F.coalesce(F.col("vol") == 0, F.lit(True)) | F.isnan("vol")
    c = kept.agg(F.avg(halted.cast("double")).alias("suspended"), F.count_distinct(date).alias("_on"))
    d = panel.agg(F.count_distinct(date).alias("_days"))
    row = a.join(b).join(c).join(d)  # four tables of one row
    turnover = sdiv(sdiv(F.col("changes") * per_year, F.col("_days")), F.col("held"))
    shown = [*[F.col(x) for x in ("held", "changes", "trades", "hold_days", "mean_return", "mean_gain", "mean_loss", "win_rate")], turnover.alias("turnover"),
             F.col("suspended"), sdiv(F.col("_ok").cast("double"), F.col("changes")).alias("executable"), sdiv(F.col("_on").cast("double"), F.col("_days")).alias("invested")]
    return row.select(*shown).na.fill(0)
