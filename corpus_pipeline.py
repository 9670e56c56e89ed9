"""A training corpus from raw documents, in five stages; each works on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, near_dedup, quality, secret_scan, source_mix
from tidemark.llm.common import materialize, release, shielded, table

#: A list of ids up to this size is broadcast; a longer one is joined by shuffle.
BROADCAST_BYTES = 16 << 20


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at its cut or above; nulls and empty texts are scored like others."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return shielded(docs, ["doc_id", "text"], lambda d: quality.scored(d, model).where(F.col("_score") >= quality.CUT).drop("_score"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of smallest id, of each group linked by a similarity of 0.8 or more.

    Rows that repeat both id and text are one document and stay or go together; another text of the same id is another
    document. Each row without an id is a document, the last to be kept. Documents without words stay.
    """
    def step(d: DataFrame) -> DataFrame:
        d = d.withColumn("_th", F.xxhash64("text"))
        found = materialize(near_dedup.near_duplicates(d.select("doc_id", "_th", "text"), ["doc_id", "_th"]).where("_class IS NOT NULL"), "near")
        key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_th")
        # written first, so that adaptive execution may split a class of many documents in the join
        first = materialize(found.groupBy("_class").agg(F.min(key).alias("first")), "first")
        gone = found.join(first, "_class").where(~key.eqNullSafe(F.col("first")))
        gone = materialize(gone.select(F.col("doc_id").alias("_gone"), F.col("_th").alias("_gone_th")).distinct(), "gone")
        small = gone.count() * 24 <= BROADCAST_BYTES
        same = F.col("doc_id").eqNullSafe(F.col("_gone")) & (F.col("_th") == F.col("_gone_th"))
        d = d.join(F.broadcast(gone) if small else gone, same, "left_anti").drop("_th")
        if docs.where("doc_id IS NULL").isEmpty():
            return d
        # equal texts without an id share a key: of those that are left, one stays
        single = F.col("doc_id").isNull() & (source_mix.word_count(F.col("text")) > 0)
        return d.where(~single).unionByName(d.where(single).dropDuplicates(["text"]))

    return shielded(docs, ["doc_id", "text"], step)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and n_chars counted anew where a text changed."""
    model = secret_scan.train(secret_scan.training_samples(docs))

    def step(d: DataFrame) -> DataFrame:
        out = secret_scan.redact(d.withColumn("_before", F.col("text")), model)
        n_chars = F.when(F.col("text").eqNullSafe(F.col("_before")), F.col("n_chars")).otherwise(F.length("text").cast("long"))
        return out.withColumn("n_chars", n_chars).select(*d.columns)

    return shielded(docs, ["text", "n_chars"], step)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, none more than three times."""
    return source_mix.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids: the token ids of each document that the mix holds."""
    coded = bpe.encode(docs.select("doc_id", "source", "text"), bpe.default_vocabulary())
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", keep_good),
    ("MinHash near-dedup", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", tokenize),
]

#: No SQL expresses the classifier; tests/llm compares the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if name != STAGES[0][0]:
            release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
