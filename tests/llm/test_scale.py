"""Large groups, hot buckets and rows repeated many times, with small blocks, against brute force."""

import random

import numpy as np
import pytest

from test_operators import brute_components, frame, removed_by_brute_force, shingles
from tidemark.llm import itq_dedup, near_dedup, suffix_dedup


def near_copies(count, base_words=60, changes=3, seed=4):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choice(words) for _ in range(base_words)]
    out = []
    for i in range(count):
        w = list(base)
        for _ in range(rng.randint(1, changes)):
            w[rng.randrange(base_words)] = rng.choice(words)
        out.append((i, " ".join(w)))
    return out


def dealt_rows(spark, monkeypatch):
    """Counts the rows that blocks of the residual pass get."""
    counter, across = spark.sparkContext.accumulator(0), near_dedup._across

    def counted(*args):
        inner = across(*args)

        def run(batches):
            def each():
                for batch in batches:
                    counter.add(batch.num_rows)
                    yield batch
            return inner(each())
        return run

    monkeypatch.setattr(near_dedup, "_across", counted)
    return counter


def test_near_copies_and_strays_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rows = near_copies(160) + [(5000 + k, near_copies(1)[0][1]) for k in range(3)]
    got = {r.doc_id: r.component_id for r in near_dedup.deduplicated(frame(spark, rows)).collect()}
    assert got == brute_components({i: shingles(t) for i, t in rows}, lambda a, b: 100 * len(a & b) >= 80 * len(a | b))


def test_near_copies_cost_in_proportion(spark, monkeypatch):
    counter, dealt = dealt_rows(spark, monkeypatch), []
    for n in (300, 600):
        before = counter.value
        near_dedup.deduplicated(frame(spark, near_copies(n, 100))).count()
        dealt.append(counter.value - before)
    assert 0 < dealt[1] < 2.6 * dealt[0]


def test_one_row_many_times(spark):
    rows = [(7, near_copies(1)[0][1])] * 500 + near_copies(5)
    docs = frame(spark, rows)
    got = {(r.doc_id, r.component_id) for r in near_dedup.deduplicated(docs).collect()}
    want = brute_components({i: shingles(t) for i, t in rows}, lambda a, b: 100 * len(a & b) >= 80 * len(a | b))
    assert got == set(want.items()) and near_dedup.deduplicated(docs).count() == len(rows)


def hot(rng):
    return np.vstack([rng.normal(size=32) + 0.2 * rng.normal(size=(700, 32)), rng.normal(size=(100, 32))])


def common_direction(rng):
    d = rng.normal(size=64)
    return 8.4 * d / np.linalg.norm(d) + 0.315 * rng.normal(size=(800, 64))


def two_directions(rng):
    d = rng.normal(size=48)
    d *= 3 / np.linalg.norm(d)
    return np.vstack([d + 0.15 * rng.normal(size=(500, 48)), d + 0.3 * rng.normal(size=(300, 48))])


@pytest.mark.parametrize("make", [hot, common_direction, two_directions])
def test_recall_on_concentrated_vectors(spark, make):
    x = make(np.random.default_rng(0))
    rows = [(i, [float(v) for v in r], i % 2) for i, r in enumerate(x)]
    got = {r.vec_id: r.n_links for r in itq_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    label = np.arange(len(x)) % 2
    want = ((n @ n.T >= 0.93) & (label[:, None] == label[None, :])).sum(axis=1) - 1
    links = np.array([got[i] for i in range(len(x))])
    assert want.sum() > 1000 and (links <= want).all() and links.sum() >= 0.99 * want.sum()


def test_a_passage_in_most_documents(spark):
    rng = random.Random(6)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(220))
    rows = [(i, "".join(rng.choice("ijklmnop") for _ in range(rng.randint(0, 90))) + passage[rng.randint(0, 60) :] + str(i)) for i in range(1800)]
    got = {r.doc_id: (r.n_removed, bytes(r.kept)) for r in suffix_dedup.without_repeats(frame(spark, rows).repartition(24)).collect()}
    assert got == removed_by_brute_force(rows)
