"""Universes: exclusion masks, boards, base and liquidity rules, eligibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one_word_limit(high: Column, low: Column, vol: Column, up: Column, down: Column, tolerance: float = 1e-4) -> Column:
    """A traded session with one price, at a limit where limits are known."""
    still = (high == low) & (vol > 0)
    at = (F.abs(high - up) <= tolerance) | (F.abs(low - down) <= tolerance)
    return F.coalesce(still & (at | up.isNull() | down.isNull()), F.lit(False))


def excluded(*reasons: Column) -> Column:
    """True if any reason holds; an unknown one counts as held."""
    out = F.lit(False)
    for r in reasons:
        out = out | F.coalesce(r, F.lit(True))
    return out


def on_board(code: Column, prefixes: list[str]) -> Column:
    """Codes that start with one of the prefixes."""
    out = F.lit(False)
    for p in prefixes:
        out = out | F.startswith(code, F.lit(p))
    return out


def mean_amount(amount: Column, rows: int, least: int, name: str = "instrument", date: str = "date") -> Column:
    """The mean traded amount of the last rows; null with fewer than `least` values."""
    w = Window.partitionBy(name).orderBy(date).rowsBetween(1 - rows, 0)
    return F.when(F.count(amount).over(w) >= least, F.avg(amount).over(w))


def universe_mask(panel: DataFrame, base: Column, out: Column, start: str, date: str = "date") -> DataFrame:
    """panel with `member`: in the base, not excluded, and on or after the start."""
    return panel.withColumn("member", F.coalesce(base, F.lit(False)) & ~out & (F.col(date) >= F.lit(start).cast("date")))


def liquidity_rules(scores: DataFrame, score: str, adv: str, k: int, floor: float, bottom: float, target_value: float, participation: float, date: str = "date", name: str = "instrument") -> DataFrame:
    """The k best scores of each date among names whose mean amount is at least the floor, at least the date's `bottom`
    quantile, and large enough that one of k equal positions stays within the participation. Ties by name.
    """
    cut = F.percentile(F.col(adv), F.lit(bottom)).over(Window.partitionBy(date))
    kept = scores.where(F.col(score).isNotNull() & F.col(adv).isNotNull()).withColumn("_cut", cut)
    kept = kept.where((F.col(adv) >= floor) & (F.col(adv) >= F.col("_cut")) & (F.col(adv) * participation >= target_value / k)).drop("_cut")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(date).orderBy(F.desc(score), name))).where(F.col("rank") <= k)


def eligible(panel: DataFrame, rules: dict[str, tuple[Column, float | None, float | None]], flags: list[Column], date: str = "date", name: str = "instrument") -> DataFrame:
    """date, name of the rows that meet every flag and lie within the bounds (low, high; None for none) of every rule; nulls fail."""
    test = F.lit(True)
    for f in flags:
        test = test & F.coalesce(f, F.lit(False))
    for x, low, high in rules.values():
        test = test & x.isNotNull()
        if low is not None:
            test = test & (x >= low)
        if high is not None:
            test = test & (x <= high)
    return panel.where(test).select(date, name)
