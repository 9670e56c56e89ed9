"""Ranks within a date: ties, nulls and signed zeros, and the shuffles of their plan."""

import math

from pyspark.sql import functions as F

from tidemark.operators import cross_section as X


def test_ranks_tie_and_take_one_shuffle(spark):
    xs = [0.0, -0.0, None, 2.0, 2.0, 2.0, -1.0, math.nan]
    df = spark.createDataFrame([(d, i, x, -x if x is not None else x) for d in (1, 2) for i, x in enumerate(xs[d - 1 :])], "date int, i int, x double, y double")
    out = df.select("date", "i", X.rank_pct(F.col("x"), "date").alias("r"), X.rank_pct(F.col("y"), "date").alias("s"))
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {(r.date, r.i): r.r for r in out.collect()}
    assert [got[1, i] for i in range(8)] == [2.5 / 7, 2.5 / 7, None, 5 / 7, 5 / 7, 5 / 7, 1 / 7, 1.0]
    assert [got[2, i] for i in range(7)] == [2 / 6, None, 4 / 6, 4 / 6, 4 / 6, 1 / 6, 1.0]
