"""Operators over one date's cross-section. Windows partition by date; nulls stay null and count for nothing."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import sdiv


def rank_pct(x: Column, *by: str) -> Column:
    """Average-tie rank over the non-null values, in (0, 1]. Ties are counted in the sort that ranks, without a shuffle by value."""
    w = Window.partitionBy(*by)
    low = F.rank().over(w.orderBy(x.asc_nulls_last()))
    same = F.count(F.lit(1)).over(w.orderBy(x.asc_nulls_last()).rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(x.isNotNull(), (low + (same - 1) / 2) / F.count(x).over(w))


def zscore(x: Column, *by: str) -> Column:
    w = Window.partitionBy(*by)
    return sdiv(x - F.avg(x).over(w), F.stddev_samp(x).over(w))


def demean(x: Column, *by: str) -> Column:
    return x - F.avg(x).over(Window.partitionBy(*by))


def winsorized(x: Column, low: float, high: float, *by: str) -> Column:
    """x clipped to the linear quantiles of its group."""
    w = Window.partitionBy(*by)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.percentile(x, F.lit(low)).over(w)), F.percentile(x, F.lit(high)).over(w)))


def composite(weights: Mapping[str, float], by: str = "date") -> Column:
    """Weighted sum of the fields' ranks (a negative weight ranks the negated field); null if any is."""
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + rank_pct(F.col(name) if weight >= 0 else -F.col(name), by) * abs(weight)
    return total


def residual(x: Column, control: Column, *by: str, min_rows: int = 10) -> Column:
    """Residual of x on one control and an intercept in each group; null with fewer than min_rows pairs."""
    w = Window.partitionBy(*by)
    both = x.isNotNull() & control.isNotNull()
    a, b = F.when(both, x), F.when(both, control)
    beta = sdiv(F.covar_samp(a, b).over(w), F.var_samp(b).over(w))
    return F.when(F.count(a).over(w) >= min_rows, a - F.avg(a).over(w) - beta * (b - F.avg(b).over(w)))


def size_industry_residual(df: DataFrame, x: str, size: str, industry: str, out: str, date: str = "date", min_rows: int = 10) -> DataFrame:
    """Residual on ln(size) and industry dummies: both are demeaned by (date, industry), then one slope a date is left.

    Rows with a null in any input get null.
    """
    ok = F.col(x).isNotNull() & (F.col(size) > 0) & F.col(industry).isNotNull()
    g, w = Window.partitionBy(date, industry), Window.partitionBy(date)
    a, b = F.when(ok, F.col(x)), F.when(ok, F.ln(F.when(F.col(size) > 0, F.col(size))))
    df = df.withColumn("_a", a).withColumn("_b", b).withColumn("_a", F.col("_a") - F.avg("_a").over(g)).withColumn("_b", F.col("_b") - F.avg("_b").over(g))
    beta = F.coalesce(sdiv(F.sum(F.col("_a") * F.col("_b")).over(w), F.sum(F.col("_b") * F.col("_b")).over(w)), F.lit(0.0))
    return df.withColumn(out, F.when(F.count("_a").over(w) >= min_rows, F.col("_a") - beta * F.col("_b"))).drop("_a", "_b")


def regression_residual(df: DataFrame, x: str, controls: list[str], out: str, date: str = "date", min_rows: int = 10) -> DataFrame:
    """Residual on any number of controls and an intercept, by least squares on each date's cross-section."""
    keys = [c for c in df.columns if c not in (x, *controls)]

    def run(frames: Iterator[pd.DataFrame] | pd.DataFrame) -> pd.DataFrame:
        ok = frames[[x, *controls]].notna().all(axis=1).to_numpy()
        res = np.full(len(frames), np.nan)
        if ok.sum() >= max(min_rows, len(controls) + 1):
            z = np.column_stack([np.ones(ok.sum()), frames.loc[ok, controls].to_numpy(float)])
            y = frames.loc[ok, x].to_numpy(float)
            res[ok] = y - z @ np.linalg.lstsq(z, y, rcond=None)[0]
        return frames[keys].assign(**{out: res})

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"{out} double"])
    return df.groupBy(date).applyInPandas(run, schema).withColumn(out, F.nanvl(F.col(out), F.lit(None).cast("double")))


def rolling_beta(x: Column, market: Column, rows: int, keys: str = "instrument", order: str = "date") -> Column:
    """(mean(xy) - mean(x) mean(y)) / sample variance of y over full windows only."""
    w = Window.partitionBy(keys).orderBy(order).rowsBetween(-(rows - 1), 0)
    both = x.isNotNull() & market.isNotNull()
    a, b = F.when(both, x), F.when(both, market)
    beta = sdiv(F.avg(a * b).over(w) - F.avg(a).over(w) * F.avg(b).over(w), F.var_samp(b).over(w))
    return F.when(F.count(a).over(w) == rows, beta)
