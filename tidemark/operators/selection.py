"""Which signals to take: shapes of quantile curves, grouped and marginal IC, correlated families, bootstrap intervals, capped families.

Factors are a catalogue's worth (hundreds), so tables with a row for each factor or pair of factors are small; pairs are
the only ones read on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import sdiv
from tidemark.operators.cross_section import rank_pct, residual
from tidemark.operators.evaluation import correlation, ic_series


def quantile_summary(buckets: DataFrame, per_year: float) -> DataFrame:
    """factor, bucket, annual_return, volatility, sharpe (null without spread) over the dates of each bucket."""
    s = buckets.groupBy("factor", "bucket").agg(F.avg("mean_return").alias("m"), F.stddev_samp("mean_return").alias("sd"))
    year = per_year**0.5
    return s.select("factor", "bucket", (F.col("m") * per_year).alias("annual_return"), (F.col("sd") * year).alias("volatility"), (sdiv(F.col("m"), F.col("sd")) * year).alias("sharpe"))


def quantile_shape(summary: DataFrame, value: str = "annual_return", flat: float = 1e-12) -> DataFrame:
    """factor, signs, shape, dominant, monotonicity (rank correlation of bucket and value); nulls with fewer than 3 buckets.

    signs: one of + - 0 for each step from a bucket to the next.
    """
    known = summary.where(F.col(value).isNotNull())
    step = F.col(value) - F.lag(value).over(Window.partitionBy("factor").orderBy("bucket"))
    sign = F.when(step > flat, "+").when(step < -flat, "-").when(step.isNotNull(), "0")
    ranked = known.withColumn("_s", sign).withColumn("_r", rank_pct(F.col(value), "factor"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_s").isNotNull(), F.struct("bucket", "_s")))), lambda x: x["_s"]), "")
    out = ranked.groupBy("factor").agg(joined.alias("signs"), F.count("*").alias("_n"), correlation(F.col("bucket"), F.col("_r")).alias("_c"))
    s = F.col("signs")
    patterns = [("monotonic_up", r"^\++$"), ("monotonic_down", r"^-+$"), ("top_reversal", r"^\++-$"), ("bottom_reversal", r"^-\++$"), ("U_shape", r"^-+\++$"), ("inverted_U", r"^\++-+$")]
    shape = F.lit("irregular")
    for name, pattern in reversed(patterns):
        shape = F.when(s.rlike(pattern), name).otherwise(shape)
    most = F.greatest(F.length(F.regexp_replace(s, r"[^+]", "")), F.length(F.regexp_replace(s, r"[^-]", "")))
    enough = F.col("_n") >= 3
    return out.select("factor", *[F.when(enough, c).alias(n) for n, c in (("signs", s), ("shape", shape), ("dominant", most / F.length(s)), ("monotonicity", F.col("_c")))])


def equal_count_groups(long: DataFrame, k: int, name: str, *by: str) -> DataFrame:
    """long with bucket 1..k by rank, ties by name, so that groups differ by one in size at most; null values have none."""
    some = long.where("value IS NOT NULL")
    r = F.row_number().over(Window.partitionBy(*by).orderBy("value", name)).cast("long")
    n = F.count("*").over(Window.partitionBy(*by))
    return some.withColumn("bucket", F.when(n > 1, F.greatest(F.expr("1"), F.floor(((r - 1) * k + n - 2) / (n - 1)))).otherwise(1).cast("int"))


def top_excess(grouped: DataFrame, label: str, k: int, date: str = "date") -> DataFrame:
    """factor, date, excess: the top group's mean label less that of all."""
    pairs = grouped.where(F.col(label).isNotNull())
    return pairs.groupBy("factor", date).agg((F.avg(F.when(F.col("bucket") == k, F.col(label))) - F.avg(label)).alias("excess")).where("excess IS NOT NULL")


def ic_by_group(long: DataFrame, label: str, group: str, min_rows: int, date: str = "date") -> DataFrame:
    """factor, group, mean_ic, days: mean rank IC within the members of each group."""
    keyed = long.where(F.col(group).isNotNull()).withColumn("factor", F.struct(F.col("factor").alias("f"), F.col(group).alias("g")))
    return ic_series(keyed, label, min_rows, date).groupBy(F.col("factor.f").alias("factor"), F.col("factor.g").alias(group)).agg(F.avg("rank_ic").alias("mean_ic"), F.count("rank_ic").alias("days"))


def marginal(panel: DataFrame, candidate: str, base: str, date: str = "date") -> DataFrame:
    """panel with factor and value: what the candidate adds to a base, its residual on it by date."""
    return panel.withColumn("value", residual(F.col(candidate), F.col(base), date)).withColumn("factor", F.lit(candidate))


def redundant(correlations: DataFrame, threshold: float) -> DataFrame:
    return correlations.where(F.abs("correlation") >= threshold)


def clusters(correlations: DataFrame, factors: list[str], threshold: float) -> DataFrame:
    """factor, cluster: connected factors of |correlation| >= threshold share a cluster, named by its first factor."""
    root = {f: f for f in factors}

    def find(f: str) -> str:
        while root[f] != f:
            f = root[f]
        return f

    for row in redundant(correlations, threshold).collect():
        low, high = sorted((find(row["a"]), find(row["b"])))
        root[high] = low
    return correlations.sparkSession.createDataFrame([(f, find(f)) for f in sorted(factors)], "factor string, cluster string")


def uncorrelated(strength: DataFrame, correlations: DataFrame, most: float) -> list[str]:
    """Factors taken greedily by |icir| (ties by name), each with |correlation| <= most to all taken before."""
    c = {frozenset((r["a"], r["b"])): abs(r["correlation"] or 0.0) for r in correlations.collect()}
    taken: list[str] = []
    for r in sorted(strength.select("factor", "icir").collect(), key=lambda r: (-abs(r["icir"] or 0.0), r["factor"])):
        if all(c.get(frozenset((r["factor"], t)), 0.0) <= most for t in taken):
            taken.append(r["factor"])
    return taken


def hash_draw(bound: Column, *parts: Column) -> Column:
    """A whole number in [0, bound) from the md5 of parts; reruns agree."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 12), 16, 10).cast("long") % bound


def block_bootstrap(series: DataFrame, value: str, order: str, block: int, draws: int, *by: str, level: float = 0.95, seed: int = 42) -> DataFrame:
    """by..., mean, ci_low, ci_high, n: interval of a mean by resampling blocks of consecutive values.

    A draw takes blocks at hash-seeded places until it is as long as the series; no interval for a series under a block.
    A series has a value for each date of a calendar, so it is one array; draws are dealt to tasks.
    """
    items = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v")))), lambda s: s["v"])
    held = series.where(F.col(value).isNotNull()).groupBy(*by).agg(items.alias("x"), F.avg(value).alias("mean"), F.count(value).alias("n"))
    blocks = F.ceil(F.col("n") / block)
    drawn = held.select(*by, "x", "mean", "n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))

    def block_sum(b: Column) -> Column:
        start = hash_draw(F.col("n") - block + 1, F.lit(seed), F.col("draw"), b)
        size = F.least(F.lit(block).cast("long"), F.col("n") - b * block)
        return F.aggregate(F.slice("x", (start + 1).cast("int"), size.cast("int")), F.lit(0.0), lambda a, v: a + v)

    total = F.aggregate(F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), block_sum), F.lit(0.0), lambda a, v: a + v)
    means = drawn.withColumn("_m", F.when(F.col("n") >= max(block, 3), total / F.col("n")))
    tail = (1 - level) / 2
    return means.groupBy(*by).agg(F.first("mean").alias("mean"), F.percentile("_m", F.lit(tail)).alias("ci_low"), F.percentile("_m", F.lit(1 - tail)).alias("ci_high"), F.first("n").alias("n"))


def family_capped(weights: DataFrame, weight: str, family: str, cap: Column, date: str = "date") -> DataFrame:
    """weight normalised by date with no family above its cap (an expression of the family; null: none).

    The excess goes to the other families in proportion. Families are capped in falling order of share over cap, each
    against what is left after those before it. If every family is capped, their caps are scaled to one.
    """
    day = Window.partitionBy(date)
    plus = F.greatest(F.coalesce(F.col(weight), F.lit(0.0)), F.lit(0.0))
    sums = weights.groupBy(date, family).agg(F.sum(plus).alias("_s")).withColumn("_cap", cap.cast("double"))
    falling = Window.partitionBy(date).orderBy(F.desc_nulls_last(F.col("_s") / F.col("_cap")), family)
    used = F.coalesce(F.sum("_cap").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("_s").over(falling.rowsBetween(0, Window.unboundedFollowing))
    sums = sums.withColumn("_over", F.coalesce(sdiv(F.col("_s") * (1 - used), rest) > F.col("_cap"), F.lit(False)))
    sums = sums.withColumn("_free", F.sum(F.when(~F.col("_over"), F.col("_s"))).over(day)).withColumn("_held", F.coalesce(F.sum(F.when(F.col("_over"), F.col("_cap"))).over(day), F.lit(0.0)))
    share = F.when(F.col("_over"), F.col("_cap")).otherwise(sdiv(F.col("_s") * (1 - F.col("_held")), F.col("_free")))
    sums = sums.withColumn("_share", share).withColumn("_share", sdiv(F.col("_share"), F.sum("_share").over(day)))
    back = weights.join(sums.select(date, F.col(family).alias("_family"), "_s", "_share"), [date], "inner").where(F.col(family).eqNullSafe(F.col("_family")))
    return back.withColumn(weight, sdiv(plus * F.col("_share"), F.col("_s"))).drop("_family", "_s", "_share")


def limit_share(code: Column, special: Column, date: Column) -> Column:
    """The daily price limit of a code on a date: special treatment 5 %, growth and innovation boards 20 % since their reforms, the northern board 30 %, else 10 %."""
    # fixed values
    growth, growth_since = ("300", "301"), "2020-08-24"
    innovation, innovation_since = ("688", "689"), "2019-07-22"
    northern = ("43", "83", "87", "88", "92")
    head = F.substring(code, 1, 3)
    since = lambda d: F.when(date >= F.lit(d).cast("date"), 0.2).otherwise(0.1)
    return (
        F.when(F.coalesce(special, F.lit(False)), 0.05).when(head.isin(*growth), since(growth_since)).when(head.isin(*innovation), since(innovation_since))
        .when(code.endswith(".BJ") | F.substring(code, 1, 2).isin(*northern), 0.3).otherwise(0.1)
    )


def with_actions(positions: DataFrame, actions: DataFrame, keys: list[str], shares: str = "shares", cost: str = "avg_cost", cash: str = "cash", bonus: str = "bonus") -> DataFrame:
    """positions after the day's corporate actions: dividend (cash a share), bonus shares in whole ones, and cost spread over them."""
    joined = positions.join(actions.select(*keys, F.col(cash).alias("_cash"), F.col(bonus).alias("_bonus")), keys, "left")
    paid = F.greatest(F.coalesce("_cash", F.lit(0.0)), F.lit(0.0)) * F.col(shares)
    more = F.floor(F.col(shares) * F.greatest(F.coalesce("_bonus", F.lit(0.0)), F.lit(0.0)))
    out = joined.withColumn("dividend", paid).withColumn("_more", more)
    return out.withColumn(cost, sdiv(F.col(cost) * F.col(shares), F.col(shares) + F.col("_more"))).withColumn(shares, F.col(shares) + F.col("_more")).drop("_cash", "_bonus", "_more")
