"""Connected components by alternating large and small stars, each round written to shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, release

#: Rounds are few (the logarithm of the longest chain, squared at worst); more mean an error.
MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to the smallest node around u."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked to the smallest of them. edges: u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node with a link to another; edges: u, v of any ordered type.

    Loops, nulls and repeated links are ignored; no links, no rows. A centre with many links costs no more than its links:
    minima are combined before the shuffle, and the joins are plain equi-joins that adaptive execution may split.
    """
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    sign = None
    for _ in range(MAX_ROUNDS):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == sign or mark[0] == 0:
            break
        # a forest of stars: no node is both a centre and a member, and each member has one centre
        if sign is not None and now.select("u").count() == now.select("u").distinct().count() and now.select("u").intersect(now.select("v")).isEmpty():
            break
        sign, before = mark, now
        now = materialize(_small_star(_large_star(before)), "stars")
        release(before)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
