"""Mixing sources to target weights.

Words are summed by source, a water-filling step turns weights into targets, and each document is emitted
floor(rate) times plus once more with probability equal to the fraction, drawn from a hash of its id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, shielded, table

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Sources in code-point order, null last, take these weights in turn.
WEIGHTS = (1, 2, 3)
#: A target is at most this many times its source's size.
MOST = 3
#: A table of targets up to this many bytes is broadcast; a larger one is joined by shuffle.
BROADCAST_BYTES = 16 << 20


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source: source, source_size, target. sized: source, size.

    All sources share the total by weight; a target above `most` times its source's size is cut to that and the
    excess reshared by weight, until none is above. This is one water level L with target = min(most * size, L * weight):
    the sources, ordered by most * size / weight, are capped from the lowest on, and L is the first level that
    leaves the next source uncapped. An empty table gives no rows; sources without words get target 0.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.array(*[F.lit(w).cast("long") for w in weights])
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sums = sums.withColumn("weight", F.element_at(weight, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    sums = sums.withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("at", F.col("cap") / F.col("weight"))
    order = Window.orderBy(F.col("at"), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    share = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levels = sums.withColumn("level", left / share).withColumn("rank", F.row_number().over(order))
    fits = F.when((F.col("level") * F.col("weight") <= F.col("cap")) & (F.col("level") > 0), F.struct("rank", "level"))
    levels = levels.withColumn("level", F.min(fits).over(everything)["level"])
    target = F.coalesce(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")), F.lit(0.0))
    return levels.select("source", "source_size", target.alias("target"))


def uniform(key: Column, seed: str = "mix") -> Column:
    """A number in [0, 1) from the md5 of seed and key; reruns agree."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def with_copies(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """docs with a struct column _mix: size, source_size, target, copies."""
    sized = docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    targets = materialize(source_targets(sized, weights, most), "targets")
    n, length = targets.agg(F.count("*"), F.coalesce(F.sum(F.length("source")), F.lit(0))).first()
    right = targets.select(F.struct("source", "source_size", "target").alias("_target"))
    if n * 64 + 4 * length <= BROADCAST_BYTES:
        right = F.broadcast(right)
    joined = docs.withColumn("_size", word_count(F.col(text_col))).join(right, F.col(source_col).eqNullSafe(F.col("_target.source")), "left")
    rate = F.coalesce(F.col("_target.target") / F.nullif(F.col("_target.source_size"), F.lit(0)), F.lit(0.0))
    copies = F.floor(rate) + (uniform(F.col(id_col)) < rate - F.floor(rate)).cast("long")
    return joined.withColumn("_mix", F.struct(F.col("_size").alias("size"), F.col("_target.source_size").alias("source_size"), F.col("_target.target").alias("target"), copies.alias("copies"))).drop("_size", "_target")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """docs with each row as often as the mix takes it; columns as before.

    Null texts have size 0, null sources are one source, a null id is drawn as the text "null"; rows that repeat an
    id draw alike. Other columns, whatever their names, go along.
    """
    def step(d: DataFrame) -> DataFrame:
        mixed = with_copies(d, id_col, text_col, source_col, weights, most)
        return mixed.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_mix.copies").cast("int")))).select(*d.columns)

    return shielded(docs, [id_col, text_col, source_col], step)


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    m = with_copies(docs, "doc_id", "text", "source")
    return m.select("doc_id", F.col("_mix.size").alias("size"), F.col("_mix.source_size").alias("source_size"), F.col("_mix.target").alias("target"), (F.col("_mix.size") * F.col("_mix.copies")).alias("taken"))


OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), sums AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY source
), caps AS (SELECT *, source_size * 3 AS cap, (source_size * 3)::DOUBLE / weight AS fill FROM sums
), levels AS (
  SELECT *, row_number() OVER o AS rank,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / (sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level
  FROM caps WINDOW o AS (ORDER BY fill, source NULLS LAST)
), best AS (SELECT min_by(level, rank) AS level FROM levels WHERE level * weight <= cap AND level > 0
), targets AS (
  SELECT source, source_size, coalesce(least(cap::DOUBLE, best.level * weight), 0.0) AS target FROM levels, best
), rated AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, coalesce(t.target / nullif(t.source_size, 0), 0.0) AS rate,
    ('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS taken FROM rated
"""
