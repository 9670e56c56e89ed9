"""How a signal holds up: rolling and walk-forward IC, decay over horizons, Sharpe ratios tested against chance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import sdiv
from tidemark.operators.evaluation import ic_summary


def rolling_ic(series: DataFrame, rows: int, ic: str = "ic", date: str = "date") -> DataFrame:
    """series with rolling_mean and rolling_icir over the last rows dates; null with fewer than half of them."""
    w = Window.partitionBy("factor").orderBy(date).rowsBetween(1 - rows, 0)
    enough = F.count(ic).over(w) >= max(rows // 2, 2)
    mean = F.avg(ic).over(w)
    return series.withColumn("rolling_mean", F.when(enough, mean)).withColumn("rolling_icir", F.when(enough, sdiv(mean, F.stddev_samp(ic).over(w))))


def walk_forward(series: DataFrame, train: int, validation: int, test: int, step: int = 1, ic: str = "ic", date: str = "date") -> DataFrame:
    """factor, fold (its first year), train_icir, validation_icir, test_icir, consistent (one sign in all three).

    A fold is train, then validation, then test years, all within the years of the factor's series; the next starts
    step years later. A date goes to the folds that hold its year, which are train + validation + test at most.
    """
    span = train + validation + test
    own = Window.partitionBy("factor")
    dated = series.withColumn("_y", F.year(date)).withColumn("_a", F.min("_y").over(own)).withColumn("_b", F.max("_y").over(own))
    dealt = dated.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(span - 1)))).withColumn("fold", F.col("_y") - F.col("_k"))
    dealt = dealt.where((F.col("fold") >= F.col("_a")) & (F.col("fold") + span - 1 <= F.col("_b")) & ((F.col("fold") - F.col("_a")) % step == 0))
    role = F.when(F.col("_k") < train, "train").when(F.col("_k") < train + validation, "validation").otherwise("test")
    parts = ic_summary(dealt.withColumn("_role", role), "factor", "fold", "_role", ic=ic)
    out = parts.groupBy("factor", "fold").agg(*[F.max(F.when(F.col("_role") == r, F.col("icir"))).alias(f"{r}_icir") for r in ("train", "validation", "test")])
    sign = [F.signum(f"{r}_icir") for r in ("train", "validation", "test")]
    return out.withColumn("consistent", (sign[0] == sign[1]) & (sign[1] == sign[2]))


def held_out(folds: DataFrame) -> DataFrame:
    """Of walk_forward's folds: the mean of what was held out, and the share of folds of one sign."""
    return folds.groupBy("factor").agg(
        F.count("*").alias("folds"), F.avg("validation_icir").alias("validation_icir"), F.avg("test_icir").alias("test_icir"),
        F.avg(F.col("consistent").cast("double")).alias("sign_consistency"),
    )


def decay_peak(summary: DataFrame, horizon: str = "horizon") -> DataFrame:
    """One row, none without an ICIR: the horizon of largest |icir| (the first of equals), that peak, and the first later horizon under half of it."""
    rows = summary.select(F.struct(F.abs("icir").alias("v"), F.col(horizon).alias("h")).alias("r")).where("r.v IS NOT NULL")
    best = rows.agg(F.max_by("r", F.struct(F.col("r.v"), -F.col("r.h"))).alias("b"), F.collect_list("r").alias("all"))  # a row for each horizon
    later = F.array_min(F.transform(F.filter("all", lambda r: (r["h"] > F.col("b.h")) & (r["v"] < F.col("b.v") / 2)), lambda r: r["h"]))
    return best.where("b IS NOT NULL").select(F.col("b.h").alias("best_horizon"), F.col("b.v").alias("peak"), later.alias("half_life"))


def normal_cdf(z: Column) -> Column:
    """The normal distribution function, by its series around 0; 0 or 1 beyond 8 deviations."""
    x = F.greatest(F.least(z, F.lit(8.0)), F.lit(-8.0))
    start = F.struct(x.alias("term"), x.alias("total"))

    def add(acc: Column, k: Column) -> Column:
        term = acc["term"] * x * x / (2 * k + 1)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    total = F.aggregate(F.sequence(F.lit(1), F.lit(150)), start, add, lambda acc: acc["total"])
    return F.when(z.isNotNull(), F.least(F.greatest(0.5 + total * F.exp(-x * x / 2) / (2 * 3.141592653589793) ** 0.5, F.lit(0.0)), F.lit(1.0)))


def adjusted_shape(value: str) -> tuple[Column, Column]:
    """Skewness and excess kurtosis, adjusted for the sample's size; null with fewer than 3 or 4 values."""
    n = F.count(value)
    skew = F.when(n > 2, F.skewness(value) * F.sqrt(n * (n - 1)) / (n - 2))
    excess = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(value) + 6))
    return skew, excess


def sharpe_significance(returns: DataFrame, value: str, per_year: float, trials: int, *by: str) -> DataFrame:
    """Annual Sharpe, and the probability that it exceeds 0 (psr) or what the best of so many trials shows by chance (dsr)."""
    skew, excess = adjusted_shape(value)
    s = returns.groupBy(*by).agg(F.count(value).alias("n"), (sdiv(F.avg(value), F.stddev_samp(value)) * per_year**0.5).alias("sharpe"), skew.alias("skewness"), excess.alias("kurtosis"))
    spread = F.sqrt(F.greatest(1 - F.col("skewness") * F.col("sharpe") + (F.col("kurtosis") + 2) / 4 * F.col("sharpe") ** 2, F.lit(1e-12)))
    bar = F.sqrt(2 * F.ln(F.lit(float(max(trials, 1))))) / per_year**0.5
    z = lambda b: (F.col("sharpe") - b) * F.sqrt(F.col("n") - 1) / spread
    return s.withColumn("psr", normal_cdf(z(F.lit(0.0)))).withColumn("dsr", normal_cdf(z(bar)))
