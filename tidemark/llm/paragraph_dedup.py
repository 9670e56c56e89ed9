"""Substring dedup of paragraphs: MinHash bands tuned for recall, exact Jaccard of colliding paragraphs, components.

A paragraph is a line of a text. Paragraphs of MIN_WORDS words or more are units of the MinHash engine in near_dedup:
equal ones are one class, bands of colliding classes give candidates, full shingle sets confirm them, and components
gather them. In a component the first paragraph stays (smallest id, then smallest place) and the others are removed.

Besides, passages of 50 words or more that repeat, in longer lines or over several lines of any length, are cut: see
passages.py.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, table
from tidemark.llm.near_dedup import PERCENT, near_duplicates
from tidemark.llm.passages import cut_text, repeated_passages

#: Shorter paragraphs are left alone: common phrases recur by chance.
MIN_WORDS = 20
#: Bins of a band, and the chance to lose a pair just at the threshold.
BINS, MISS = 4, 1e-3


def tuned(percent: int, miss: float = MISS, bins: int = BINS) -> tuple[int, int]:
    """(bands, bins): as many bands as keep the loss at the threshold under `miss`."""
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** bins)), bins


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, place, text of every line; a null text has none. row numbers the documents (ids may repeat)."""
    slim = docs.select(F.xxhash64(id_col, text_col).alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("whole"))
    return slim.select("row", "doc_id", F.posexplode(F.split("whole", "\n", -1)).alias("place", "text"))


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """row, place, first_doc: the paragraphs to remove, and the document that keeps the first of their kind."""
    units = paragraphs(docs, id_col, text_col)
    found = near_duplicates(units, ["row", "doc_id", "place"], "text", percent, shape=tuned(percent), min_words=min_words)
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "place")
    first = materialize(found.where("_class IS NOT NULL").groupBy("_class").agg(F.min(key).alias("first"), F.count("*").alias("size")).where("size > 1"), "first")
    return found.join(first, "_class").where(~key.eqNullSafe(F.col("first"))).select("row", "place", F.col("first.doc_id").alias("first_doc")).distinct()


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_paragraphs, n_removed, removed (places, from 0), first_docs (where their first is kept), kept_text, n_cut.

    One row per document. A null text has no paragraphs and stays null; a text may become empty. Lines are rejoined
    with the line breaks between them. Rows that repeat id and text share their removals: the copy is not removed from
    itself. Repeated passages are cut from the lines that hold them; n_cut counts their words, less those of lines that
    are removed whole. Other columns are not read.
    """
    gone = materialize(removals(docs, id_col, text_col, percent, min_words), "removals")
    lists = gone.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "first_doc"))).alias("gone"))  # at most a document's lines
    slim = docs.select(F.xxhash64(id_col, text_col).alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    both = lists.join(repeated_passages(slim, lists), "row", "full")
    joined = slim.join(both, "row", "left").withColumn("lines", F.split("text", "\n", -1))
    removed = F.coalesce(F.transform("gone", lambda g: g["place"]), F.array().cast("array<int>"))
    marked = F.map_from_arrays(removed, F.transform(removed, lambda _: F.lit(True)))
    kept = F.filter("lines", lambda x, i: ~F.coalesce(F.element_at(F.col("marked"), i), F.lit(False)))
    joined = joined.withColumn("removed", removed).withColumn("marked", F.when(F.size(removed) > 0, marked))
    # null but for texts with cuts, so that only these go to Python
    cut = F.udf(cut_text, "struct<removed:array<int>,n_cut:bigint,kept:string>", useArrow=False)
    has = F.col("cuts").isNotNull()
    joined = joined.withColumn("cut", cut(F.when(has, F.col("text")), F.col("cuts"), F.when(has, F.col("removed"))))
    places = F.when(has, F.col("cut.removed")).otherwise(F.col("removed"))
    firsts = F.concat(*[F.coalesce(c, F.array().cast("array<bigint>")) for c in (F.transform("gone", lambda g: g["first_doc"]), F.col("origins"))])
    return joined.select(
        "doc_id", F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_paragraphs"), F.size(places).cast("long").alias("n_removed"), places.alias("removed"),
        F.array_sort(F.array_distinct(firsts)).alias("first_docs"),
        F.when(has, F.col("cut.kept")).when(F.col("marked").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
        F.coalesce("cut.n_cut", F.lit(0)).cast("long").alias("n_cut"),
    )


def op2_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_paragraphs", "n_removed", "removed", "first_docs", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"), "n_cut")
