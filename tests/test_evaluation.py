"""Evaluation operators against DuckDB."""

import random

import duckdb

from tidemark.operators import evaluation as E
from tidemark.operators import selection as K
from tidemark.queries import ORACLE_SQL, rounded


def test_bucket_edges_round_as_in_sql(spark):
    rng = random.Random(5)
    # twelfths of sums: equal numbers that differ in the last bit, so that edges fall between them
    rows = [("f", d, i, sum(rng.sample([j / 11 for j in range(9)], 4)) / 12 * rng.choice([1, 1, -1]), float(i)) for d in range(300) for i in range(rng.randint(1, 40))]
    rows += [("f", 900, i, 0.3, 1.0) for i in range(4)] + [("f", 901, 0, None, 1.0), ("f", 902, 0, 1e308, 1.0), ("f", 902, 1, 1.1e308, 1.0)]
    long = spark.createDataFrame(rows, "factor string, date int, i int, value double, label double")
    got = sorted((r.date, r.i, r.bucket) for r in E.quantile_buckets(long, 5, "factor", "date").collect() if r.bucket is not None)
    con = duckdb.connect()
    con.execute("CREATE TABLE pairs (factor VARCHAR, date INT, i INT, value DOUBLE, label DOUBLE)")
    con.executemany("INSERT INTO pairs VALUES (?, ?, ?, ?, ?)", rows)
    want = con.execute("""WITH edges AS (SELECT factor, date, min(value) AS m, list_distinct(quantile_cont(value, [0.2, 0.4, 0.6, 0.8])) AS e FROM pairs WHERE value IS NOT NULL GROUP BY ALL)
    SELECT date, i, len(list_filter(e, lambda v: v > m AND v < value)) + 1 FROM pairs JOIN edges USING (factor, date) WHERE value IS NOT NULL ORDER BY ALL""").fetchall()
    assert got == [tuple(r) for r in want]


def test_shapes_follow_the_edges_of_sql(spark):
    rng = random.Random(6)
    # as above, values one bit from an edge; with few rows in a bucket one of them turns a step or a rank of its factor
    rows = [(f"f{f}", d, sum(rng.sample([j / 11 for j in range(9)], 4)) / 12, rng.expovariate(0.2)) for f in range(400) for d in range(2) for _ in range(f % 40 + 1)]
    buckets = E.quantile_returns(spark.createDataFrame(rows, "factor string, date int, value double, label double"), "label", 5)
    got = sorted(tuple(r) for r in rounded(K.quantile_shape(K.quantile_summary(buckets, 52.0)).where("shape IS NOT NULL")).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE pairs (factor VARCHAR, date INT, value DOUBLE, label DOUBLE)")
    con.executemany("INSERT INTO pairs VALUES (?, ?, ?, ?)", rows)
    sql = ORACLE_SQL["quantile_shape"]
    assert got == sorted(con.execute(f"WITH {sql[sql.index('edges AS ('):]}").fetchall()) and len(got) > 300
