"""Disclosure and selection operators on cases worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import disclosures as D
from tidemark.operators import selection as K


def day(text):
    return dt.date.fromisoformat(text)


def test_single_quarters_follow_a_restatement(spark):
    rows = [("a", "2024-03-31", "2024-05-06", 10.0), ("a", "2024-06-30", "2024-08-02", 25.0), ("a", "2024-03-31", "2024-09-02", 12.0), ("b", "2024-06-30", "2024-08-02", 7.0)]
    ledger = spark.createDataFrame([(e, day(p), day(d), v) for e, p, d, v in rows], "e string, p date, d date, v double")
    got = {(r.e, str(r.d)): (r.sq_q0, r.sq_q1, r.ttm, r.qoq) for r in D.quarters(ledger, "e", "p", "d", "v").collect()}
    assert got == {("a", "2024-05-06"): (10.0, None, None, None), ("a", "2024-08-02"): (15.0, 10.0, None, 0.5), ("a", "2024-09-02"): (13.0, 12.0, None, pytest.approx(1 / 12)), ("b", "2024-08-02"): (None, None, None, None)}
    assert D.quarters(ledger.limit(0), "e", "p", "d", "v").count() == 0
    last = {(r.e, str(r.p)): r.v for r in D.latest_quarters(ledger, "e", "p", "d", "v").collect()}
    assert last == {("a", "2024-03-31"): 12.0, ("a", "2024-06-30"): 13.0, ("b", "2024-06-30"): None}


def test_consensus_takes_each_organisations_latest_and_lets_it_expire(spark):
    rows = [("a", "x", "2024-01-01", 1, 10.0), ("a", "y", "2024-01-02", 2, 20.0), ("a", "x", "2024-01-03", 3, 14.0), ("a", "z", "2024-01-12", 4, None)]
    reports = spark.createDataFrame([(e, o, day(d), n, v) for e, o, d, n, v in rows], "e string, o string, d date, n int, v double")
    got = {str(r.d): (r.median, r.organisations) for r in D.consensus(reports, "e", "o", "d", ["n"], "v", 10).collect()}
    assert got == {"2024-01-01": (10.0, 1), "2024-01-02": (15.0, 2), "2024-01-03": (17.0, 2), "2024-01-12": (14.0, 1)}


def test_rating_spells(spark):
    days = [("2024-01-01", 1), ("2024-01-05", 2), ("2024-01-09", 2), ("2024-02-01", 1), ("2024-02-03", None), ("2024-02-05", 3), ("2024-02-06", 2), ("2024-02-07", 3)]
    rows = spark.createDataFrame([("a", "x", day(d), v) for d, v in days], "e string, o string, d date, v int")
    spells = D.rating_episodes(rows, "e", "o", "d", "v", 10)
    got = sorted((str(r.start), str(r.end), r.direction) for r in spells.collect())
    # reaffirming on the 9th doesn't prolong; an unknown rating ends the spell and hides the next change
    assert got == [("2024-01-05", "2024-01-15", 1), ("2024-02-01", "2024-02-03", -1), ("2024-02-06", "2024-02-07", -1), ("2024-02-07", "2024-02-17", 1)]
    counts = {str(r.date): (r.ups, r.downs) for r in D.spell_counts(spells, "e").collect()}
    assert counts["2024-01-05"] == (1, 0) and counts["2024-01-15"] == (0, 0) and counts["2024-02-07"] == (1, 0) and counts["2024-02-17"] == (0, 0)


def test_membership_ends(spark):
    spans = spark.createDataFrame([("a", day("2024-01-01"), day("2024-01-10"), "i"), ("a", day("2024-01-20"), day("2099-12-31"), "j")], "e string, s date, t date, l string")
    days = spark.createDataFrame([("a", day(f"2024-01-{d:02d}")) for d in (1, 10, 11, 20)] + [("a", day("2023-12-31")), ("b", day("2024-01-05"))], "e string, d date")
    got = {(r.e, str(r.d)): r.l for r in D.member_asof(days, spans, "e", "d", "s", "t", "l").collect()}
    assert got == {("a", "2024-01-01"): "i", ("a", "2024-01-10"): "i", ("a", "2024-01-11"): None, ("a", "2024-01-20"): "j", ("a", "2023-12-31"): None, ("b", "2024-01-05"): None}


@pytest.mark.parametrize(("values", "shape"), [([1, 2, 3, 4], "monotonic_up"), ([4, 3, 2], "monotonic_down"), ([1, 2, 3, 2], "top_reversal"), ([3, 1, 2, 4], "bottom_reversal"), ([5, 3, 1, 2, 4], "U_shape"), ([1, 3, 5, 4, 2], "inverted_U"), ([1, 1, 2], "irregular"), ([1, 2], None)])
def test_shapes(spark, values, shape):
    rows = spark.createDataFrame([("f", i, float(v)) for i, v in enumerate(values)], "factor string, bucket int, annual_return double")
    assert K.quantile_shape(rows).first()["shape"] == shape


def test_clusters_and_greedy_choice(spark):
    pairs = spark.createDataFrame([("a", "b", 0.9), ("b", "c", -0.8), ("c", "d", 0.1), ("a", "d", None)], "a string, b string, correlation double")
    assert {r.factor: r.cluster for r in K.clusters(pairs, list("dcba"), 0.8).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d"}
    strength = spark.createDataFrame([("a", 0.2), ("b", -0.9), ("c", 0.5), ("d", None)], "factor string, icir double")
    assert K.uncorrelated(strength, pairs, 0.7) == ["b", "d"]


def test_family_caps(spark):
    rows = [(1, "a", 0.6), (1, "a", 0.2), (1, "b", 0.1), (1, None, 0.1), (2, "a", 1.0), (2, "b", 1.0)]
    df = spark.createDataFrame(rows, "date int, family string, w double")
    cap = F.when(F.col("family") == "a", 0.5).when(F.col("family") == "b", 0.25)
    got = [(r.date, r.family, round(r.w, 9)) for r in K.family_capped(df, "w", "family", cap).collect()]
    # on the first date the excess of a goes to b and the rest alike; on the second both are capped and scaled to one
    assert sorted(got, key=str) == sorted([(1, "a", 0.375), (1, "a", 0.125), (1, "b", 0.25), (1, None, 0.25), (2, "a", round(2 / 3, 9)), (2, "b", round(1 / 3, 9))], key=str)


def test_bootstrap_needs_a_block(spark):
    rows = [("a", i, float(i % 5)) for i in range(50)] + [("b", i, 1.0) for i in range(3)] + [("c", 0, None)]
    df = spark.createDataFrame(rows, "k string, d int, v double")
    got = {r.k: r for r in K.block_bootstrap(df, "v", "d", 5, 100, "k").collect()}
    assert set(got) == {"a", "b"} and got["a"].ci_low == got["a"].ci_high == got["a"]["mean"] == 2.0
    assert got["b"].ci_low is None and got["b"]["mean"] == 1.0
