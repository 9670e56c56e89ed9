import datetime as dt

from tidemark.operators import temporal as T

D = dt.date


def test_restatement_does_not_demote_and_slots_are_revised(spark):
    rows = [("a", D(2024, 3, 31), D(2024, 5, 6), 10.0), ("a", D(2024, 6, 30), D(2024, 8, 2), 20.0), ("a", D(2024, 3, 31), D(2024, 9, 2), 12.0)]
    ledger = spark.createDataFrame(rows, "e string, p date, d date, v double")
    newest = {r.d: r.v for r in T.newest_period(ledger, "e", "p", "d", "v").collect()}
    assert newest == {D(2024, 5, 6): 10.0, D(2024, 8, 2): 20.0, D(2024, 9, 2): 20.0}
    slots = {r.d: (r.q0, r.q1) for r in T.slots(ledger, "e", "p", "d", "v", 2).collect()}
    assert slots == {D(2024, 5, 6): (10.0, None), D(2024, 8, 2): (20.0, 10.0), D(2024, 9, 2): (20.0, 12.0)}


def test_strictly_next_open_day(spark):
    calendar = spark.createDataFrame([(D(2024, 1, d),) for d in (4, 5, 8)], "date date")
    rows = spark.createDataFrame([(D(2024, 1, d),) for d in (1, 4, 5, 6, 8)], "d date")
    got = {r.d: r.effective_date for r in T.visible_from(rows, "d", calendar).collect()}
    assert got == {D(2024, 1, 1): D(2024, 1, 4), D(2024, 1, 4): D(2024, 1, 5), D(2024, 1, 5): D(2024, 1, 8), D(2024, 1, 6): D(2024, 1, 8), D(2024, 1, 8): None}


def test_intervals_merge_when_adjacent(spark):
    rows = [("a", D(2024, 1, 1), D(2024, 1, 3)), ("a", D(2024, 1, 4), D(2024, 1, 5)), ("a", D(2024, 1, 9), D(2024, 1, 9))]
    got = T.merged_intervals(spark.createDataFrame(rows, "e string, start date, end date"), "e", "start", "end").collect()
    assert sorted((r.start, r.end) for r in got) == [(D(2024, 1, 1), D(2024, 1, 5)), (D(2024, 1, 9), D(2024, 1, 9))]
