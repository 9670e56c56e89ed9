"""Point-in-time operators: calendars, visibility, versions, intervals and event states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_day_no(calendar: DataFrame, date: str = "date") -> DataFrame:
    """Open days with their position, from 0. A calendar has thousands of rows at most, so one sorted task is enough."""
    return calendar.select(date).distinct().withColumn("pos", (F.row_number().over(Window.orderBy(date)) - 1).cast("int"))


def next_open(calendar: DataFrame, date: str = "date") -> DataFrame:
    """civil, next_open, pos for every civil day from the first open day to the last: the first open day after it."""
    days = with_day_no(calendar, date).select(F.col(date).alias("open"), "pos")
    later = F.lead("open").over(Window.orderBy("open"))
    gaps = days.select("open", later.alias("next_open"), (F.col("pos") + 1).alias("pos")).where("next_open IS NOT NULL")
    return gaps.select(F.explode(F.sequence("open", F.date_sub("next_open", 1))).alias("civil"), "next_open", "pos")


def visible_from(rows: DataFrame, disclosed: str, calendar: DataFrame, lag: int = 0, date: str = "date") -> DataFrame:
    """rows with effective_date: the open day strictly after disclosure, `lag` open days on; null past the calendar's end."""
    steps = next_open(calendar, date)
    days = with_day_no(calendar, date).select(F.col(date).alias("effective_date"), F.col("pos").alias("_pos"))
    first = F.broadcast(calendar.agg(F.min(date).alias("_first")))  # one row
    found = rows.join(steps.select(F.col("civil").alias("_civil"), F.col("pos").alias("_next")), F.col(disclosed) == F.col("_civil"), "left").join(first, how="cross")
    at = F.when(F.col(disclosed) < F.col("_first"), 0).otherwise(F.col("_next")) + lag
    return found.withColumn("_pos", at).join(days, "_pos", "left").drop("_pos", "_civil", "_next", "_first")


def latest_versions(rows: DataFrame, keys: list[str], priority: list[Column], fields: list[str]) -> DataFrame:
    """One row for each key: each field from the best version in which it isn't null. priority: best first, total."""
    order = Window.partitionBy(*keys).orderBy(*priority)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    picked = [F.first(f, ignorenulls=True).over(whole).alias(f) for f in fields]
    return rows.select(*keys, *picked, F.row_number().over(order).alias("_n")).where("_n = 1").drop("_n")


def conflicts(rows: DataFrame, keys: list[str], field: str) -> DataFrame:
    """Keys with two values of a field, or a value and a null."""
    seen = rows.groupBy(*keys).agg(F.count_distinct(field).alias("values"), F.count(field).alias("known"), F.count("*").alias("n"))
    return seen.where((F.col("values") > 1) | ((F.col("known") > 0) & (F.col("known") < F.col("n")))).select(*keys)


def newest_period(ledger: DataFrame, entity: str, period: str, effective: str, value: str) -> DataFrame:
    """entity, effective, period, value of the newest period visible at each effective date, in its latest version.

    A restatement of an older period never demotes the newest one; a reported null of the newest period stays null.
    """
    so_far = Window.partitionBy(entity).orderBy(effective).rangeBetween(Window.unboundedPreceding, 0)
    best = F.max(F.struct(F.col(period).alias("p"), F.col(effective).alias("e"), F.col(value).alias("v"))).over(so_far)
    return ledger.select(entity, effective, best.alias("_b")).select(entity, effective, F.col("_b.p").alias(period), F.col("_b.v").alias(value)).distinct()


def slots(ledger: DataFrame, entity: str, period: str, effective: str, value: str, depth: int = 4) -> DataFrame:
    """entity, effective, q0.. q{depth-1}: the newest visible periods in their latest versions, newest first.

    The visible state is one array of (period, value) for each entity and effective date, folded from its own events.
    """
    so_far = Window.partitionBy(entity).orderBy(effective).rangeBetween(Window.unboundedPreceding, 0)
    seen = F.collect_list(F.struct(F.col(period).alias("p"), F.col(effective).alias("e"), F.col(value).alias("v"))).over(so_far)
    state = ledger.select(entity, effective, F.sort_array(seen, asc=False).alias("s")).distinct()
    # in falling order of (period, effective) a period's first entry is its latest version
    heads = F.filter("s", lambda x, i: (i == 0) | (F.get("s", i - 1)["p"] != x["p"]))
    return state.select(entity, effective, heads.alias("h")).select(entity, effective, *[F.get("h", F.lit(k))["v"].alias(f"q{k}") for k in range(depth)]).distinct()


def asof(facts: DataFrame, days: DataFrame, entity: str, effective: str, date: str, fields: list[str]) -> DataFrame:
    """days with the fields of each entity's latest fact at or before the day, nulls of that fact kept."""
    left = facts.select(entity, F.col(effective).alias(date), F.struct(*fields).alias("_f"), F.lit(0).alias("_day"))
    right = days.select(entity, date, F.lit(None).cast(left.schema["_f"].dataType).alias("_f"), F.lit(1).alias("_day"))
    w = Window.partitionBy(entity).orderBy(date, "_day").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("_f", F.last("_f", ignorenulls=True).over(w)).where("_day = 1")
    return both.select(entity, date, *[F.col(f"_f.{f}").alias(f) for f in fields])


def merged_intervals(rows: DataFrame, entity: str, start: str, end: str, gap: int = 1) -> DataFrame:
    """Overlapping or adjacent (gap days) closed date intervals of an entity as one."""
    w = Window.partitionBy(entity).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col(start) > F.date_add(before, gap)), 1).otherwise(0)
    marked = rows.withColumn("_new", fresh).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(entity, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def islands(flags: DataFrame, entity: str, position: str, date: str) -> DataFrame:
    """Runs of consecutive calendar positions: entity, start, end, days."""
    w = Window.partitionBy(entity).orderBy(position)
    runs = flags.withColumn("_run", F.col(position) - F.row_number().over(w))
    return runs.groupBy(entity, "_run").agg(F.min(date).alias("start"), F.max(date).alias("end"), F.count("*").alias("days")).drop("_run")


def covered(days: DataFrame, intervals: DataFrame, entity: str, date: str, start: str = "start", end: str = "end") -> DataFrame:
    """The days within an interval of their entity, both ends included."""
    spans = intervals.select(F.col(entity).alias("_e"), F.col(start).alias("_s"), F.col(end).alias("_t"))
    return days.join(spans, (F.col(entity) == F.col("_e")) & F.col(date).between(F.col("_s"), F.col("_t")), "left_semi")


def active_counts(events: DataFrame, entity: str, member: str, position: str, ttl: int) -> DataFrame:
    """entity, position, active: members whose latest event lies at most ttl - 1 positions back, for every change.

    Members' windows are merged first, so a member counts once; a running sum of starts less ends then sweeps the line.
    """
    w = Window.partitionBy(entity, member).orderBy(position)
    spans = events.select(entity, member, position).distinct().withColumn("_next", F.lead(position).over(w))
    own = F.col("_next").isNull() | (F.col("_next") > F.col(position) + ttl)
    first = F.lag(position).over(w)
    marks = spans.withColumn("_first", first.isNull() | (F.col(position) > first + ttl)).withColumn("_last", own)
    ups = marks.where("_first").select(entity, F.col(position).alias("position"), F.lit(1).alias("d"))
    downs = marks.where("_last").select(entity, (F.col(position) + ttl).alias("position"), F.lit(-1).alias("d"))
    steps = ups.union(downs).groupBy(entity, "position").agg(F.sum("d").alias("d"))
    return steps.select(entity, "position", F.sum("d").over(Window.partitionBy(entity).orderBy("position")).alias("active"))


def forward_label(panel: DataFrame, price: str, horizon: int, out: str, entity: str = "instrument", position: str = "day_no") -> DataFrame:
    """price at exactly `horizon` positions ahead over price now, less one; null where that position has none."""
    ahead = panel.select(entity, (F.col(position) - horizon).alias(position), F.col(price).alias("_p"))
    return panel.join(ahead, [entity, position], "left").withColumn(out, F.try_divide("_p", price) - 1).drop("_p")
