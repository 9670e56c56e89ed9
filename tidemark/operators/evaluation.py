"""Signal evaluation. Factors are stacked to long form first, so one aggregate serves any number of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import fused, sdiv
from tidemark.operators.cross_section import rank_pct


def stacked(panel: DataFrame, factors: list[str], keep: list[str]) -> DataFrame:
    """keep..., factor, value: one row for each factor of each panel row."""
    pairs = F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).alias("value")) for f in factors])
    return panel.select(*keep, F.explode(pairs).alias("_f")).select(*keep, "_f.factor", "_f.value")


def correlation(x: Column, y: Column) -> Column:
    return sdiv(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def ic_series(long: DataFrame, label: str, min_rows: int = 20, date: str = "date") -> DataFrame:
    """factor, date, ic (Pearson), rank_ic (Spearman, average ranks), n over complete pairs; dates with enough of them."""
    pairs = long.where(F.col("value").isNotNull() & F.col(label).isNotNull())
    pairs = pairs.withColumn("_rx", rank_pct(F.col("value"), "factor", date)).withColumn("_ry", rank_pct(F.col(label), "factor", date))
    return pairs.groupBy("factor", date).agg(
        correlation(F.col("value"), F.col(label)).alias("ic"), correlation(F.col("_rx"), F.col("_ry")).alias("rank_ic"), F.count("*").alias("n")
    ).where(F.col("n") >= min_rows)


def ic_summary(series: DataFrame, *by: str, ic: str = "ic") -> DataFrame:
    """mean, sd, icir (0 without spread), hit rate (share with the mean's sign) and days of an IC series."""
    mean = F.avg(ic)
    out = series.groupBy(*by).agg(mean.alias("mean_ic"), F.stddev_samp(ic).alias("sd_ic"), F.avg((F.col(ic) > 0).cast("double")).alias("positive"), F.count(ic).alias("days"))
    icir = F.when(F.col("sd_ic") > 0, F.col("mean_ic") / F.col("sd_ic")).otherwise(0.0)
    return out.withColumn("icir", icir).withColumn("hit", F.when(F.col("mean_ic") >= 0, F.col("positive")).otherwise(1 - F.col("positive")))


def quantile_buckets(long: DataFrame, n: int, *by: str) -> DataFrame:
    """long with bucket 1..n by right-closed value edges; equal edges count once, nulls get none.

    An edge is low * (1 - d) + high * d, the first product and the sum rounded once, as in SQL: values may lie one bit from it.
    """
    values = long.where("value IS NOT NULL").groupBy(*by).agg(F.sort_array(F.collect_list(F.col("value").cast("double"))).alias("_v"))

    def edge(q: Column) -> Column:
        place = (F.size("_v") - 1) * q
        low, d = F.floor(place).cast("int"), place - F.floor(place)
        return F.when(d == 0, F.get("_v", low)).otherwise(fused(F.get("_v", low), 1 - d, F.get("_v", low + 1) * d))

    edges = values.select(*by, F.array(*[edge(F.lit(i / n)) for i in range(1, n)]).alias("_e"), F.get("_v", F.lit(0)).alias("_m"))
    inner = F.filter(F.array_distinct("_e"), lambda e: e > F.col("_m"))
    joined = long.join(edges.withColumn("_e", inner), list(by), "left")
    bucket = F.size(F.filter("_e", lambda e: e < F.col("value"))) + 1
    return joined.withColumn("bucket", F.when(F.col("value").isNotNull(), bucket)).drop("_e", "_m")


def quantile_returns(long: DataFrame, label: str, n: int, date: str = "date") -> DataFrame:
    """factor, date, bucket, mean label and count."""
    pairs = long.where(F.col("value").isNotNull() & F.col(label).isNotNull())
    return quantile_buckets(pairs, n, "factor", date).groupBy("factor", date, "bucket").agg(F.avg(label).alias("mean_return"), F.count("*").alias("n"))


def long_short(buckets: DataFrame, n: int, date: str = "date") -> DataFrame:
    """Top less bottom bucket of each date that has both."""
    top, low = (F.max(F.when(F.col("bucket") == b, F.col("mean_return"))) for b in (n, 1))
    return buckets.groupBy("factor", date).agg((top - low).alias("spread")).where("spread IS NOT NULL")


def hac_t(series: DataFrame, value: str, position: str, lags: int, *by: str) -> DataFrame:
    """by..., mean, t: Newey-West t of a mean, Bartlett weights, lags in places of the ordered series."""
    w = Window.partitionBy(*by).orderBy(position)
    c = series.where(F.col(value).isNotNull()).withColumn("_d", F.col(value) - F.avg(value).over(Window.partitionBy(*by)))
    for lag in range(1, lags + 1):
        c = c.withColumn(f"_l{lag}", F.col("_d") * F.lag("_d", lag).over(w))
    n = F.count("_d")
    s = F.sum(F.col("_d") * F.col("_d")) / n
    for lag in range(1, lags + 1):
        s = s + 2 * (1 - lag / (lags + 1)) * F.coalesce(F.sum(f"_l{lag}"), F.lit(0.0)) / n
    return c.groupBy(*by).agg(F.avg(value).alias("mean"), sdiv(F.avg(value), F.sqrt(F.greatest(s, F.lit(0.0)) / n)).alias("t"), n.alias("n"))


def factor_correlations(panel: DataFrame, factors: list[str], date: str = "date") -> DataFrame:
    """a, b, correlation: ranks of rows complete in all factors, correlated by date, then averaged."""
    whole = panel.dropna(subset=factors)
    ranked = whole.select(date, *[rank_pct(F.col(f), date).alias(f) for f in factors])
    pairs = [(a, b) for i, a in enumerate(factors) for b in factors[i + 1 :]]
    by_date = ranked.groupBy(date).agg(*[correlation(F.col(a), F.col(b)).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    means = by_date.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.avg(f"_{i}").alias("correlation")) for i, (a, b) in enumerate(pairs)]).alias("p"))
    return means.select(F.explode("p").alias("p")).select("p.*")


def bucket_turnover(members: DataFrame, position: str, name: str) -> DataFrame:
    """position, turnover: half the sum of weight changes of an equal-weight set between consecutive positions."""
    sized = members.withColumn("_w", 1 / F.count("*").over(Window.partitionBy(position)))
    dates = members.select(position).distinct().withColumn("_next", F.lead(position).over(Window.orderBy(position))).where("_next IS NOT NULL")
    after = sized.select(F.col(position).alias("_p"), name, F.col("_w").alias("_b"))
    before = sized.join(dates, position).select(F.col("_next").alias("_p"), name, F.col("_w").alias("_a"))
    changed = before.join(after, ["_p", name], "full").join(dates.select(F.col("_next").alias("_p")), "_p", "left_semi")
    return changed.groupBy(F.col("_p").alias(position)).agg((F.sum(F.abs(F.coalesce("_b", F.lit(0.0)) - F.coalesce("_a", F.lit(0.0)))) / 2).alias("turnover"))
