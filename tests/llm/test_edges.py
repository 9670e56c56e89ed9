"""Nulls, empty texts and tables, repeated rows, very long texts and clashing column names, operator by operator."""

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe, hmm_score, itq_dedup, near_dedup, paragraph_dedup, quality, secret_scan, source_mix, suffix_dedup, topk_search

#: Names that the operators use for columns of their own.
TAKEN = "_score _gone _before _size _target _mix _copy _base _spans _kinds _random _state ids decoded kept component_id row place size source_size target word class id key h n c"
LONG = "alpha beta gamma delta " * 20_000
LINE = " ".join(f"word{i}" for i in range(40))
ROWS = [(1, "a short text with a few words", "s"), (1, "a short text with a few words", "s"), (2, None, None), (3, "", "s"), (None, "a text without an id here", "t"), (4, LONG, "t"), (5, f"{LINE}\n{LINE}", None)]
LABELS = [(1, 1), (2, 0), (3, None), (None, 1), (4, 1), (5, 0)]


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    return plain.select("*", *[F.lit(i).alias(n) for i, n in enumerate(TAKEN.split())])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int")


def by_id(df):
    rows = df.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((r[0] is None, r[0] or 0) for r in ROWS)
    return {r.doc_id: r for r in rows}


def same_columns(got, docs):
    assert got.columns == docs.columns
    for r in got.select(*TAKEN.split()).collect():
        assert list(r) == list(range(len(TAKEN.split())))


def test_near_dedup(docs):
    got = by_id(near_dedup.deduplicated(docs))
    assert got[2].n_shingles == got[3].n_shingles == 0 and got[2].kept and got[3].kept
    assert (got[1].component_id, got[1].kept, got[1].n_shingles) == (1, True, 3)
    assert got[None].component_id is None and got[None].kept and got[4].n_shingles == 4
    assert near_dedup.deduplicated(docs.limit(0)).count() == 0


def test_paragraph_dedup(docs):
    got = by_id(paragraph_dedup.without_repeats(docs))
    assert got[5].removed == [1] and got[5].kept_text == LINE and got[5].first_docs == [5]
    assert got[4].kept_text == LONG and got[2].kept_text is None and got[3].n_paragraphs == 1
    assert paragraph_dedup.without_repeats(docs.limit(0)).count() == 0


def test_suffix_dedup(docs):
    got = by_id(suffix_dedup.without_repeats(docs))
    assert got[2].n_bytes == got[3].n_bytes == 0 and got[1].n_removed == 0
    assert got[4].n_removed == len(LONG) - 23 and got[4].n_spans == 1
    assert got[5].n_removed == len(LINE) and got[5].n_spans == 1


def test_secrets(docs):
    model = secret_scan.train(secret_scan.training_samples(docs))
    got = by_id(secret_scan.scan(docs, model))
    assert all(r["_base"] == [] for r in got.values())
    same_columns(secret_scan.redact(docs, model), docs)
    empty = docs.limit(0)
    assert secret_scan.redact(empty, secret_scan.train(secret_scan.training_samples(empty))).count() == 0


def test_hidden_markov_scores(docs):
    got = by_id(hmm_score.score(docs))
    assert got[2].n_tokens == got[3].n_tokens == 1 and not got[None].held_out and got[4].n_tokens == 80_001
    assert all(r.score < 0 for r in got.values())
    assert hmm_score.score(docs.limit(0)).count() == 0


def test_hidden_markov_without_training_texts(spark):
    import zlib

    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = hmm_score.score(spark.createDataFrame([(held, "only held out")], "doc_id long, text string")).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 4, 0, 0, 0.0)


def test_quality(docs, labels):
    model = quality.fit(docs, labels)
    scored = quality.scored(docs, model)
    got = by_id(scored.select("doc_id", F.col(scored.columns[scored.columns.index("_score")])))
    assert all(0 <= r["_score"] <= 1 for r in got.values())
    assert quality.scored(docs.limit(0), quality.fit(docs.limit(0), labels.limit(0))).count() == 0


def test_mixing(docs):
    same_columns(source_mix.mix(docs), docs)
    assert source_mix.mix(docs.limit(0)).columns == docs.columns
    wordless = docs.where("doc_id IN (2, 3)")
    assert source_mix.mix(wordless).count() == 0


def test_bpe(docs):
    path = bpe.default_vocabulary()
    got = by_id(bpe.encode(docs, path, out="tokens"))
    assert got[2].tokens == got[3].tokens == []
    whole = by_id(bpe.decode(bpe.encode(docs, path, out="tokens"), path, ids_col="tokens", out="back"))
    library = Tokenizer.from_file(path)
    assert whole[4].back == library.decode(library.encode(LONG, add_special_tokens=False).ids, skip_special_tokens=False) and whole[2].back == ""
    again = by_id(bpe.encode(docs, path))
    assert again[4].ids == whole[4].tokens and again[4].kept == whole[4].kept
    assert bpe.digest(docs.limit(0), path).count() == 0


def test_top_k(spark):
    schema = "id long, terms array<long>, weights array<long>, score long, rank int, qb int"
    rows = spark.createDataFrame([(0, [1], [2], 1, 1, 1), (3, [1], [2], 1, 1, 1), (2, [1], [2], 1, 1, 1), (9, [], [], 1, 1, 1), (8, None, None, 1, 1, 1), (None, [1], [9], 1, 1, 1)], schema)
    got = topk_search.top_k(rows, rows.where("id = 0"), 2).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in got) == [(1, 2, 4), (2, 3, 4)]
    assert topk_search.top_k(rows.limit(0), rows, 2).count() == topk_search.top_k(rows, rows.limit(0), 2).count() == 0


def test_vectors(spark):
    schema = "vec_id long, embedding array<double>, label int, hash string, cid long, vec string, dim int"
    v = [1.0, 2.0, 3.0]
    rows = [(7, v, 1), (3, v, 1), (3, v, 1), (4, v, None), (5, [], 1), (6, None, 1), (8, [1.0, None, 2.0], 1), (9, [float("inf"), 1.0, 1.0], 1), (10, [2.0, 4.0], 1)]
    df = spark.createDataFrame([(*r, "h", 1, "v", 2) for r in rows], schema)
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in itq_dedup.near_vectors(df).collect())
    assert got == [(3, 2, 3, True), (3, 2, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 2, 3, False), (8, 0, 8, True), (9, 0, 9, True), (10, 0, 10, True)]
    assert itq_dedup.near_vectors(df.limit(0)).count() == 0
