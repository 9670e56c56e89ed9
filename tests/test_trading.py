"""The order simulator by hand, and the operators that no query reaches."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import holdings as H
from tidemark.operators import lifecycle as L
from tidemark.operators import portfolio as P
from tidemark.plans import catalog
from tidemark.sources import tables
from tidemark.streaming import events

D = [dt.date(2024, 1, d) for d in (1, 2, 3, 4)]
FREE = P.Costs(commission=0.0, least=0.0, transfer=0.0, stamp=0.0, slippage=0.0, lot=1, participation=1.0)


def simulated(spark, schedule, prices, cash=1000.0, costs=FREE):
    s = spark.createDataFrame([("x", D[i], k, w) for i, k, w in schedule], "scenario string, date date, instrument string, weight double")
    p = spark.createDataFrame([(D[i], *r) for i, *r in prices], "date date, instrument string, open double, close double, vol double, up double, down double")
    return [tuple(r) for r in P.simulate(s, p, cash, costs).orderBy("date").collect()]


def test_fills_and_values(spark):
    prices = [(0, "a", 10.0, 11.0, 100.0, None, None), (1, "a", 12.0, 12.0, 100.0, None, None)]
    got = simulated(spark, [(0, "a", 0.5), (1, "a", 0.25)], prices)
    # 50 shares at 10; then 1100 is worth 0.25 * 1100 / 12 = 22 shares, so 28 go at 12
    assert got == [("x", D[0], 1050.0, 500.0, 1, 500.0), ("x", D[1], 1100.0, 836.0, 1, 336.0)]


def test_costs_slippage_lots_and_participation(spark):
    costs = P.Costs(lot=10, participation=0.1)
    got = simulated(spark, [(0, "a", 1.0)], [(0, "a", 10.0, 10.0, 3.0, None, None)], 10_000.0, costs)
    # at most 3 lots of 10 times 0.1 of the volume: 3 shares, which is no whole lot
    assert got == [("x", D[0], 10_000.0, 10_000.0, 0, 0.0)]
    got = simulated(spark, [(0, "a", 0.01)], [(0, "a", 10.0, 10.0, 100.0, None, None)], 10_000.0, costs)
    value = 10 * 10.0 * 1.001
    assert got[0][3] == pytest.approx(10_000 - value - 5.0 - 0.00001 * value) and got[0][5] == pytest.approx(value)


def test_limits_shut_one_side(spark):
    up = [(0, "a", 11.0, 11.0, 100.0, 11.0, 9.0)]
    assert simulated(spark, [(0, "a", 1.0)], up)[0][4] == 0
    down = [(0, "a", 10.0, 10.0, 100.0, None, None), (1, "a", 9.0, 9.0, 100.0, 11.0, 9.0), (2, "a", 9.5, 9.5, 100.0, 9.9, 8.1)]
    got = simulated(spark, [(0, "a", 1.0), (1, "a", 0.0), (2, "a", 0.0)], down)
    assert [r[4] for r in got] == [1, 1, 0] and got[2][3] == 950.0


def test_names_that_leave_are_closed_at_their_last_price(spark):
    prices = [(0, "a", 10.0, 10.0, 100.0, None, None), (1, "a", None, 8.0, 0.0, None, None)] + [(i, "b", 5.0, 5.0, 100.0, None, None) for i in range(4)]
    got = simulated(spark, [(0, "a", 1.0), (0, "b", 0.0)], prices)
    assert [r[2] for r in got] == [1000.0, 800.0, 800.0, 800.0] and [r[4] for r in got] == [1, 1, 0, 0] and got[2][3] == 800.0


def test_scalars(spark):
    row = spark.range(1).select(
        S.parsed_date(F.lit("20240229")).alias("a"), S.parsed_date(F.lit("2024-02-29")).alias("b"), S.parsed_date(F.lit("n/a")).alias("c"), S.percent_change(F.lit(3.0), F.lit(-2.0)).alias("d"),
        S.percent_change(F.lit(3.0), F.lit(0.0)).alias("e"), S.analyst_id(F.lit(" Alpha  Research, Inc."), F.lit("Z. Roe; A. Low")).alias("f"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e) == (dt.date(2024, 2, 29), dt.date(2024, 2, 29), None, 250.0, None)
    assert row.f == "alpha research|A. Low,Z. Roe"


def test_weights(spark):
    w = lambda rows: spark.createDataFrame(rows, "date string, instrument string, weight double")
    got = {(r.date, r.instrument): r.weight for r in P.blended(w([("d", "a", 1.0)]), w([("d", "a", 0.5), ("d", "b", 0.5)]), 0.75, ["date", "instrument"]).collect()}
    assert got == {("d", "a"): 0.875, ("d", "b"): 0.125}


def test_category():
    assert catalog.category("mom_12") == "momentum" and catalog.category("q_roe") == "statement" and catalog.category("none") is None


def test_year_sink_and_window_read(spark, tmp_path):
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=90 * i), k, float(i)) for i in range(12) for k in ("a", "b", "c")]
    tables.write_by_year(spark.createDataFrame(rows, "date date, instrument string, close double"), f"{tmp_path}/bars")
    read = tables.read_window(spark, f"{tmp_path}/bars", "2021-06-01", "2022-03-01", 100)
    first = dt.date(2021, 6, 1) - dt.timedelta(days=100)
    assert sorted((r.date, r.instrument) for r in read.collect()) == sorted((d, k) for d, k, _ in rows if first <= d <= dt.date(2022, 3, 1))
    assert "PartitionFilters: [isnotnull(year" in read._jdf.queryExecution().toString()


def test_event_stream(spark, tmp_path):
    schema, t0 = "event_id long, ts timestamp, user_id long, event_type string, value double, props string", dt.datetime(2024, 1, 1)
    days = [[(i, t0 + dt.timedelta(days=d, hours=i % 24), i % 3, f"k{i % 2}", float(i), None) for i in range(d * 10, d * 10 + 12)] for d in range(4)]
    for d, rows in enumerate(days):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = events.windowed_totals(events.first_seen(events.event_stream(spark, f"{tmp_path}/in", 10)), late=None)
    run = stream.writeStream.format("memory").queryName("totals").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    got = {(r.start, r.event_type): (r.n, r.total) for r in spark.table("totals").collect()}
    every = events.windowed_totals(spark.read.schema(schema).parquet(f"{tmp_path}/in").dropDuplicates(["event_id"]))
    assert got and all(n > 0 for n, _ in got.values()) and len(got) <= every.count()


def test_spells_and_trades(spark):
    held = [(0, "a"), (0, "b"), (1, "a"), (2, "b"), (3, "b")]
    members = spark.createDataFrame([(D[i], k) for i, k in held], "date date, instrument string")
    got = {(r.instrument, r.entry, r.exit) for r in H.spells(members.union(members)).collect()}
    assert got == {("a", D[0], D[2]), ("b", D[0], D[1]), ("b", D[2], None)}
    rows = [(D[i], k, p, v, up, False) for i, k, p, v, up in [(0, "a", 10.0, 1.0, False), (2, "a", 12.0, 1.0, False), (0, "b", 5.0, 0.0, True), (1, "b", 4.0, None, False), (2, "b", None, 1.0, False), (3, "b", 1.0, 1.0, False)]]
    panel = spark.createDataFrame(rows, "date date, instrument string, close double, vol double, limit_up boolean, limit_down boolean")
    changed = {r.date: (r.held, r.bought, r.sold, r.executable) for r in H.changes(members, panel).collect()}
    assert changed == {D[0]: (2, 2, 0, 1), D[1]: (1, 0, 1, 1), D[2]: (1, 1, 1, 2), D[3]: (1, 0, 0, 0)}
    r = H.trading_statistics(members, panel, "close", 4.0, 0.0, 0.0).first()
    assert (r.held, r.changes, r.trades, r.hold_days, r.win_rate, r.turnover, r.invested) == (1.25, 5, 2, 2.5, 0.5, pytest.approx(5 / 1.25), 1.0)
    assert (r.mean_gain, r.mean_loss, r.mean_return, r.executable) == (pytest.approx(0.2), pytest.approx(-0.2), pytest.approx(0.0), pytest.approx(4 / 5))
    assert r.suspended == pytest.approx(2 / 5)  # b on the first date, and a on the second, where it has no row
    none = H.trading_statistics(members.limit(0), panel.limit(0), "close", 4.0).first()
    assert set(none.asDict().values()) == {0}


def test_status_rules(spark):
    rows = [(True, 0.2, 0.2, 0.7), (False, 0.2, 0.2, 0.9), (True, 0.2, 0.09, 0.9), (True, 0.3, -0.2, 0.9), (True, 0.3, 0.01, 0.9), (True, None, 0.2, 0.9), (True, 0.2, 0.2, None), (None, 0.2, 0.2, 0.9)]
    df = spark.createDataFrame(rows, "ok boolean, i double, o double, c double").coalesce(1)
    got = [tuple(r) for r in df.select(L.candidate_status(F.col("ok"), F.col("o"), F.col("c")), L.historical_status(F.col("ok"), F.col("i"), F.col("o"), F.col("c"))).collect()]
    assert got == [("candidate", "candidate"), ("draft", "draft"), ("draft", "draft"), ("candidate", "deprecated"), ("draft", "deprecated"), ("candidate", "draft"), ("draft", "draft"), ("draft", "draft")]
    sides = spark.createDataFrame([("long", 0.1, 1.5), ("Short ", -0.1, -1.5), ("short", 0.1, -1.5), ("inverse", -0.1, -1.5), ("long", None, 1.5), ("long", 0.1, 1.0)], "s string, i double, l double").coalesce(1)
    assert [r[0] for r in sides.select(L.aligned_pass(F.col("s"), F.col("i"), F.col("l"))).collect()] == [True, True, False, False, False, False]


def test_marginal_picks():
    metrics = {"a": ("x", 0.5), "b": ("x", -0.49), "c": ("y", 0.3), "d": ("y", 0.2), "e": ("z", 0.01)}
    rho = {("a", "b"): 0.9, ("a", "c"): 0.1, ("c", "d"): 0.2}
    assert [f for f, _ in L.select_marginal(metrics, rho, {}, 0.1)] == ["a", "c", "d"]
    assert [f for f, _ in L.select_marginal(metrics, rho, {"y": 1}, 0.02)] == ["a", "c", "b"]
    assert [f for f, _ in L.select_marginal({"e": ("z", 0.01)}, {}, {}, 0.5)] == ["e"] and L.select_marginal({}, {}, {}, 0.1) == []
