"""What filings and analysts say: single quarters out of cumulative statements, revisions, consensus and ratings.

A ledger has one value for each (entity, period, effective date). What is visible of an entity at an effective date is
one array of its periods' latest versions, so every figure is computed from the state of its own date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import sdiv


def visible_state(ledger: DataFrame, entity: str, period: str, effective: str, value: str) -> DataFrame:
    """entity, effective, h: array of (p, e, v), newest period first, each in its latest version."""
    so_far = Window.partitionBy(entity).orderBy(effective).rangeBetween(Window.unboundedPreceding, 0)
    seen = F.collect_list(F.struct(F.col(period).alias("p"), F.col(effective).alias("e"), F.col(value).alias("v"))).over(so_far)
    state = ledger.select(entity, effective, F.sort_array(seen, asc=False).alias("s")).dropDuplicates([entity, effective])
    return state.select(entity, effective, F.filter("s", lambda x, i: (i == 0) | (F.get("s", i - 1)["p"] != x["p"])).alias("h"))


def _of_period(state: Column, period: Column, field: str) -> Column:
    return F.get(F.filter(state, lambda y: y["p"] == period), F.lit(0))[field]


def _quarter_before(period: Column) -> Column:
    return F.date_sub(F.date_trunc("quarter", period), 1)


def single_quarter(state: Column, x: Column) -> Column:
    """A cumulative value less that of the quarter before it, as both are visible; a first quarter as it is."""
    return F.when(F.month(x["p"]) == 3, x["v"]).otherwise(x["v"] - _of_period(state, _quarter_before(x["p"]), "v"))


def quarters(ledger: DataFrame, entity: str, period: str, effective: str, value: str, depth: int = 4) -> DataFrame:
    """entity, effective, sq_q0.. of the newest periods, ttm (their first four; null if one is), yoy and qoq of sq_q0.

    yoy and qoq compare with the same quarter a year before and the quarter before, over the earlier one's size.
    """
    state = visible_state(ledger, entity, period, effective, value)
    own = state.withColumn("q", F.transform("h", lambda x: F.struct(x["p"].alias("p"), single_quarter(F.col("h"), x).alias("v"))))
    slot = lambda k: F.get("q", F.lit(k))["v"]
    newest = F.get("q", F.lit(0))["p"]
    grown = lambda before: sdiv(slot(0) - before, F.abs(before))
    return own.select(
        entity, effective, *[slot(k).alias(f"sq_q{k}") for k in range(depth)], (slot(0) + slot(1) + slot(2) + slot(3)).alias("ttm"),
        grown(_of_period(F.col("q"), F.last_day(F.add_months(newest, -12)), "v")).alias("yoy"), grown(_of_period(F.col("q"), _quarter_before(newest), "v")).alias("qoq"),
    )


def stability(ledger: DataFrame, entity: str, period: str, effective: str, value: str, depth: int = 12, least: int = 8) -> DataFrame:
    """entity, effective, stability: population deviation of the newest `depth` periods' values; null with fewer than `least`."""
    state = visible_state(ledger, entity, period, effective, value)
    known = F.filter(F.transform(F.slice("h", 1, depth), lambda x: x["v"]), lambda v: v.isNotNull())
    n = F.size("k")
    mean = F.aggregate("k", F.lit(0.0), lambda a, v: a + v) / n
    spread = F.aggregate("k", F.lit(0.0), lambda a, v: a + (v - F.col("m")) * (v - F.col("m"))) / n
    return state.select(entity, effective, known.alias("k")).withColumn("m", F.when(n >= least, mean)).select(entity, effective, F.sqrt(F.when(n >= least, spread)).alias("stability"))


def latest_quarters(ledger: DataFrame, entity: str, period: str, effective: str, value: str) -> DataFrame:
    """entity, period, value: single quarters of a cumulative ledger in the versions seen last."""
    newest = ledger.groupBy(entity, period).agg(F.max_by(value, effective).alias("_v"))
    before = Window.partitionBy(entity).orderBy(period)
    adjacent = F.lag(period).over(before) == _quarter_before(F.col(period))
    own = F.when(F.month(period) == 3, F.col("_v")).when(adjacent, F.col("_v") - F.lag("_v").over(before))
    return newest.withColumn(value, own).drop("_v")


def canonical_quarters(direct: DataFrame, derived: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, direct, derived, value: a reported single quarter wins over one derived from cumulative values."""
    both = direct.select(*keys, F.col(value).alias("direct")).join(derived.select(*keys, F.col(value).alias("derived")), keys, "full")
    return both.withColumn(value, F.coalesce("direct", "derived"))


def parity(canonical: DataFrame, *by: str, tolerance: float = 1e-6) -> DataFrame:
    """How reported and derived quarters agree: both, direct_only, derived_only, differing, max_error."""
    error = F.abs(F.col("direct") - F.col("derived"))
    direct, derived = F.col("direct").isNotNull(), F.col("derived").isNotNull()
    return canonical.groupBy(*by).agg(
        F.count_if(direct & derived).alias("both"), F.count_if(direct & ~derived).alias("direct_only"), F.count_if(~direct & derived).alias("derived_only"),
        F.count_if(error > tolerance * F.greatest(F.abs("direct"), F.lit(1.0))).alias("differing"), F.max(error).alias("max_error"),
    )


def revisions(forecasts: DataFrame, who: list[str], entity: str, date: str, order: list[str], value: str, step: float = 1e-9) -> DataFrame:
    """entity, date, up, down: forecasts above or below the same analyst's last one for the same period (`who` names both)."""
    last = F.lag(value).over(Window.partitionBy(entity, *who).orderBy(*order))
    moved = forecasts.select(entity, date, (F.col(value) - last).alias("_d"))
    return moved.groupBy(entity, date).agg(F.count_if(F.col("_d") > step).alias("up"), F.count_if(F.col("_d") < -step).alias("down"))


def consensus(forecasts: DataFrame, entity: str, organisation: str, date: str, order: list[str], value: str, ttl: int) -> DataFrame:
    """entity, date, median, organisations: over each organisation's latest forecast of the last ttl days, for every report date.

    A day's forecasts reach the report dates of the ttl days after it, and stop where their organisation's next one starts.
    """
    w = Window.partitionBy(entity, organisation).orderBy(date)
    daily = forecasts.groupBy(entity, organisation, date).agg(F.max_by(value, F.struct(*order)).alias("_v"))
    held = daily.withColumn("_until", F.least(F.date_add(date, ttl), F.coalesce(F.lead(date).over(w), F.date_add(date, ttl)))).select(entity, organisation, "_v", F.col(date).alias("_from"), "_until")
    dates = forecasts.select(F.col(entity).alias("_e"), date).distinct()
    found = held.join(dates, (F.col(entity) == F.col("_e")) & (F.col(date) >= F.col("_from")) & (F.col(date) < F.col("_until")))
    return found.groupBy(entity, date).agg(F.percentile("_v", F.lit(0.5)).alias("median"), F.count("_v").alias("organisations"))


def rating_episodes(ratings: DataFrame, entity: str, organisation: str, date: str, level: str, ttl: int) -> DataFrame:
    """entity, organisation, start, end (not included), direction (1 up, -1 down): spells of a changed rating.

    One rating a day is expected of an organisation. A spell starts where the level differs from the one before, ends
    ttl days after its start, whatever reaffirms it, or where the next change or an unknown rating (null) comes first.
    A rating without one before it, or after an unknown one, starts no spell.
    """
    w = Window.partitionBy(entity, organisation).orderBy(date)
    before = F.lag(level).over(w)
    turns = ratings.select(entity, organisation, date, level, before.alias("_b"), F.row_number().over(w).alias("_n"))
    turns = turns.where((F.col("_n") == 1) | ~F.col(level).eqNullSafe(F.col("_b")))
    end = F.least(F.date_add(date, ttl), F.coalesce(F.lead(date).over(w), F.date_add(date, ttl)))
    spells = turns.withColumn("_end", end).where(F.col(level).isNotNull() & F.col("_b").isNotNull())
    return spells.select(entity, organisation, F.col(date).alias("start"), F.col("_end").alias("end"), F.signum(F.col(level) - F.col("_b")).cast("int").alias("direction"))


def spell_counts(episodes: DataFrame, entity: str) -> DataFrame:
    """entity, date, ups, downs: spells of each direction that are live from that date on, for every change (a swept line)."""
    steps = F.array(F.struct(F.col("start").alias("date"), F.lit(1).alias("s")), F.struct(F.col("end").alias("date"), F.lit(-1).alias("s")))
    marks = episodes.select(entity, "direction", F.explode(steps).alias("m"))
    delta = marks.groupBy(entity, F.col("m.date").alias("date")).agg(*[F.sum(F.when(F.col("direction") == d, F.col("m.s")).otherwise(0)).alias(n) for n, d in (("ups", 1), ("downs", -1))])
    so_far = Window.partitionBy(entity).orderBy("date")
    return delta.select(entity, "date", F.sum("ups").over(so_far).alias("ups"), F.sum("downs").over(so_far).alias("downs"))


def member_asof(days: DataFrame, spans: DataFrame, entity: str, date: str, start: str, end: str, label: str) -> DataFrame:
    """days with the label of the latest span begun by then; null where that span is over, or none has begun."""
    from tidemark.operators.temporal import asof

    found = asof(spans.withColumnRenamed(start, "_in"), days, entity, "_in", date, [end, label])
    return found.select(entity, date, F.when(F.col(date) <= F.col(end), F.col(label)).alias(label))


def listing_masks(days: DataFrame, listings: DataFrame, entity: str, date: str, listed: str, delisted: str, age: int = 365) -> DataFrame:
    """days with listed (from the listing to before the delisting; false without one) and young (under `age` days old)."""
    joined = days.join(listings.select(entity, listed, delisted), entity, "left")
    on = F.coalesce((F.col(date) >= F.col(listed)) & (F.col(delisted).isNull() | (F.col(date) < F.col(delisted))), F.lit(False))
    young = F.coalesce(F.datediff(date, listed) < age, F.lit(False))
    return joined.select(entity, date, on.alias("listed"), (on & young).alias("young"))
