"""Exact top-k search by exhaustive term-at-a-time accumulation.

Rows are sparse: (term, weight) postings. Queries meet every row in blocks: a block of rows is an inverted list per
term, each query term scatters its weighted postings into a dense score array, the block keeps each query's k best
by partition selection, and the blocks' winners are merged. Nothing is pruned, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import partitions, table

#: Rows and queries of a block; a task holds one score array of their product (8 bytes each).
BLOCK_ROWS = 4096
BLOCK_QUERIES = 512


def quantized(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as long; null for a null vector or one that holds null or non-finite components."""
    x = F.transform(vector, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)), F.transform(x, lambda v: F.floor(v * scale).cast("long")))


def _block(frame: pd.DataFrame) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Row ids in order, and for each term the rows that hold it with their weights."""
    frame = frame.sort_values("id", kind="stable")
    lengths = frame["weights"].map(len).to_numpy(np.int64)
    row = np.repeat(np.arange(len(frame)), lengths)
    term = np.concatenate(frame["terms"].to_list()) if len(frame) else np.zeros(0, np.int64)
    weight = np.concatenate(frame["weights"].to_list()) if len(frame) else np.zeros(0, np.int64)
    order = np.argsort(term, kind="stable")
    term, row, weight = term[order], row[order], weight[order]
    edges = np.flatnonzero(np.r_[True, term[1:] != term[:-1], True]) if len(term) else np.zeros(1, int)
    return frame["id"].to_numpy(), {int(term[a]): (row[a:b], weight[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)}


def accumulate(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """Each query's k best rows of one block, its own row left out; ties to the smaller id."""
    ids, lists = _block(rows)
    asked, wanted = _block(queries)
    scores = np.zeros((len(asked), len(ids)), np.int64)
    for term, (q, qw) in wanted.items():
        if term in lists:
            r, rw = lists[term]
            if len(r) == len(ids):
                scores[q] += qw[:, None] * rw[None, :]
            else:
                scores[np.ix_(q, r)] += qw[:, None] * rw[None, :]
    low = np.iinfo(np.int64).min + 1  # negated below
    own = ids[None, :] == asked[:, None]
    scores[own] = low
    if len(ids) > k:
        # the k-th best score; rows tied with it stand in id order, so the first of them stay
        edge = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        above = scores > edge
        tied = (scores == edge) & (np.cumsum(scores == edge, axis=1) <= k - above.sum(axis=1, keepdims=True))
        keep = above | tied
    else:
        keep = np.ones_like(own)
    q, r = np.nonzero(keep & ~own)
    return pd.DataFrame({"query_id": asked[q], "vec_id": ids[r], "score": scores[q, r]})


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "id", terms_col: str = "terms", weights_col: str = "weights", block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products over all rows but its own id.

    rows and queries: id (long), terms array<long>, weights array<long>; terms of a row are distinct. Rows with a null
    id or null terms take no part. Two rows of one id are both candidates. An empty side gives no rows. Scores must
    fit 64 bits. Queries are dealt to all row blocks (an equi-join of block numbers), never row by row.
    """
    pick = [F.col(id_col).cast("long").alias("id"), F.col(terms_col).alias("terms"), F.col(weights_col).alias("weights")]
    rows = rows.select(*pick).dropna()
    queries = queries.select(*pick).dropna()
    n, m = rows.count(), queries.count()
    n_blocks, m_blocks = max(1, -(-n // block_rows)), max(1, -(-m // block_queries))
    row_block = F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int")
    query_block = F.pmod(F.xxhash64("id"), F.lit(m_blocks)).cast("int")
    cells = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = queries.withColumn("qb", query_block).withColumn("rb", cells(n_blocks))
    right = rows.withColumn("rb", row_block).withColumn("qb", cells(m_blocks))
    found = (
        left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb"))
        .applyInPandas(lambda q, r: accumulate(q, r, k), "query_id long, vec_id long, score long")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), quantized(F.col("embedding")).alias("dense")).where("dense IS NOT NULL")
    at = F.sequence(F.lit(0).cast("long"), F.size("dense").cast("long") - 1)
    sparse = F.filter(F.when(F.size("dense") > 0, F.arrays_zip(at.alias("t"), F.col("dense").alias("w"))), lambda p: p["w"] != 0)
    rows = rows.withColumn("postings", sparse).select("id", F.col("postings.t").alias("terms"), F.col("postings.w").alias("weights"))
    return top_k(rows, rows.where("id % 50 = 0"), 5)


OP3_SQL = """
WITH clean AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM clean q JOIN clean c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
