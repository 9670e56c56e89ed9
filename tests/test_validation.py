"""Validation and portfolio statistics against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import portfolio as P
from tidemark.operators import validation as V


def test_normal_distribution(spark):
    zs = [-40.0, -8.0, -3.0, -0.5, 0.0, 0.1, 1.96, 5.0, 7.9, 40.0, None]
    got = [r.p for r in spark.createDataFrame([(z,) for z in zs], "z double").select(V.normal_cdf(F.col("z")).alias("p")).collect()]
    assert got[-1] is None
    assert got[:-1] == pytest.approx([(1 + math.erf(z / 2**0.5)) / 2 for z in zs[:-1]], abs=1e-12)


def test_capped_weights_are_the_fixed_point(spark):
    rng = random.Random(2)
    days = {d: [rng.random() ** 4 for _ in range(n)] for d, n in enumerate([3, 5, 9, 12, 30])}
    days[90] = [1.0] * 5
    rows = [(d, i, w) for d, ws in days.items() for i, w in enumerate(ws)] + [(91, 0, None), (91, 1, -1.0)]
    got = {(r.date, r.instrument): r.weight for r in P.capped_weights(spark.createDataFrame(rows, "date int, instrument int, weight double"), "weight", 0.2).collect()}
    assert all(got[0, i] is None for i in range(3)) and got[91, 0] is None
    for d, ws in days.items():
        if len(ws) * 0.2 < 1 - 1e-12:
            continue
        want, fixed = [w / sum(ws) for w in ws], set()
        while over := {i for i, w in enumerate(want) if w > 0.2 + 1e-12}:
            fixed |= over
            free = sum(w for i, w in enumerate(want) if i not in fixed)
            want = [0.2 if i in fixed else w * (1 - 0.2 * len(fixed)) / free for i, w in enumerate(want)]
        assert [got[d, i] for i in range(len(ws))] == pytest.approx(want)


def test_folds_stay_within_the_years(spark):
    rows = [("f", f"{y}-{m:02d}-01", 0.1 * m if y < 2004 else -0.1 * m) for y in range(2000, 2006) for m in (1, 5, 9)]
    series = spark.createDataFrame(rows, "factor string, date string, ic double").withColumn("date", F.to_date("date"))
    got = sorted((r.fold, r.consistent) for r in V.walk_forward(series, 2, 1, 1).collect())
    assert got == [(2000, True), (2001, False), (2002, False)]
    assert V.held_out(V.walk_forward(series, 2, 1, 1)).first().folds == 3
    assert V.walk_forward(series.limit(0), 2, 1, 1).count() == 0
    assert V.walk_forward(series, 9, 1, 1).count() == 0


def test_payoff_without_losses(spark):
    rows = [("up", 0.1), ("up", 0.2), ("flat", 0.0), ("none", None)]
    got = {r.k: r.profit_factor for r in P.payoff(spark.createDataFrame(rows, "k string, r double"), "r", "k").collect()}
    assert got == {"up": math.inf, "flat": 0.0, "none": 0.0}
