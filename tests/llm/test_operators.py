"""The training-data operators against brute force, libraries and round trips, with nulls, empty tables and repeats."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import bpe, hmm_score, itq_dedup, near_dedup, paragraph_dedup, quality, secret_scan, source_mix, suffix_dedup, topk_search

WORD = re.compile("[^\x20\x09-\x0d]+")


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def shingles(text):
    w = WORD.findall((text or "").lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(sets, linked):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in range(len(ids)):
        for b in range(a + 1, len(ids)):
            if linked(sets[ids[a]], sets[ids[b]]):
                x, y = sorted((find(ids[a]), find(ids[b])))
                root[y] = x
    return {i: find(i) for i in ids}


def test_near_dedup(spark):
    rng, words = random.Random(3), [f"w{i}" for i in range(50)]
    base = [rng.choice(words) for _ in range(60)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(60)] = rng.choice(words)
        rows.append((i, " ".join(w)))
    rows += [(500, None), (501, ""), (502, "a b"), (503, "A  b"), (504, "x" * 50_000), (505, rows[0][1])]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.deduplicated(frame(spark, rows), percent=85).collect()}
    sets = {i: shingles(t) for i, t in rows}
    want = brute_components(sets, lambda a, b: a and b and 100 * len(a & b) >= 85 * len(a | b))
    assert got == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}
    assert near_dedup.deduplicated(frame(spark, [])).count() == 0


def test_suffix_dedup(spark):
    rng = random.Random(1)
    base = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(50, 700))) for _ in range(8)]
    rows = [(i, "".join(rng.choice(base)[: rng.randint(40, 600)] + str(rng.random()) for _ in range(rng.randint(0, 4)))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "a" * 1000), (103, "a" * 150), (104, "\x00" * 300 + "é" * 200)]
    seen, want = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        want[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.without_repeats(frame(spark, rows)).collect()}
    assert got == want
    assert suffix_dedup.without_repeats(frame(spark, [])).count() == 0


def test_paragraph_dedup(spark):
    rng = random.Random(2)
    line = lambda: " ".join(f"v{rng.randrange(10**6)}" for _ in range(60))
    passage = line()
    near = passage.replace(passage.split()[30], "changed")
    rows = [(1, f"{line()}\n{passage}\nshort line"), (2, f"{passage}\n{line()}\nshort line"), (3, near), (4, None), (5, ""), (6, line())]
    got = {r.doc_id: r for r in paragraph_dedup.without_repeats(frame(spark, rows)).collect()}
    assert [got[i].n_removed for i in range(1, 7)] == [0, 1, 1, 0, 0, 0]
    assert got[2].removed == [0] and got[2].first_docs == [1] and got[3].kept_text == ""
    assert got[1].kept_text == rows[0][1] and got[4].kept_text is None


def test_embedding_dedup(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 64))
    rows, vectors = [], {}
    for i in range(300):
        v = centres[i % 20] + rng.normal(size=64) * rng.choice([0.05, 0.2, 0.35])
        vectors[i] = v
        rows.append((i, [float(x) for x in v], i % 2))
    rows += [(900, None, 1), (901, [0.0] * 64, 1), (902, [float("nan")] * 64, 1), (903, rows[0][1], None), (904, rows[0][1], 0)]
    vectors[904] = vectors[0]
    got = {r.vec_id: r for r in itq_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    label = {r[0]: r[2] for r in rows}
    cos = lambda a, b: a @ b / np.sqrt((a @ a) * (b @ b))
    links = {i: sum(1 for j in vectors if j != i and label[j] == label[i] and cos(vectors[i], vectors[j]) >= 0.93) for i in vectors}
    assert sum(got[i].n_links for i in vectors) >= 0.97 * sum(links.values())
    assert all(got[i].n_links <= links[i] for i in vectors)
    assert all(got[i].n_links == 0 and got[i].kept for i in (900, 901, 902, 903))


def test_top_k(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(-3, 4, (120, 8))
    df = spark.createDataFrame([(i, list(range(8)), [int(v) for v in r]) for i, r in enumerate(x)], "id long, terms array<long>, weights array<long>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk_search.top_k(df, df.where("id % 10 = 0"), 5, block_rows=30, block_queries=4).collect())
    want = []
    for q in range(0, 120, 10):
        order = sorted((-int(x[q] @ x[c]), c) for c in range(120) if c != q)[:5]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(order)]
    assert got == sorted(want)


def test_secrets(spark):
    rules = [("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 12), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16)]
    rng = random.Random(5)
    parts = ["password=", "token: ", "token==", "API_KEY = '", "secret=token=", "AKIA", "ABCDEFGHIJKLMNOPQR", "deadbeef" * 3, "é😀", "x", "0123456789abcdef01", " ", "\n", "aGVsbG8gd29ybGQhIQ==", "ordinary words here "]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))) for i in range(100)] + [(900, None), (901, "deadbeefdeadbeef " * 500)]
    model = secret_scan.train(secret_scan.training_samples(frame(spark, rows)))
    for r in secret_scan.scan(frame(spark, rows), model).collect():
        want = sorted((m.start(), k, m.end(), kind) for k, (kind, p, g, n) in enumerate(rules) for m in p.finditer(r.text or "") if len(m.group(g)) >= n)
        assert [(s.start, s.end, s.kind) for s in r._base] == [(a, b, kind) for a, _, b, kind in want]
        assert {(s.start, s.end) for s in r._base} <= {(s.start, s.end) for s in r._spans}
    out = {r.doc_id: r.text for r in secret_scan.redact(frame(spark, [(1, "a token=abcdefghijkl z"), (2, None), (3, "plain")]), model).collect()}
    assert out == {1: "a [SECRET] z", 2: None, 3: "plain"}


def test_mixing(spark):
    rows = [(i, "w " * (i % 9 + 1), None if i % 5 == 4 else f"s{i % 4}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a, b = source_mix.mix(df).collect(), source_mix.mix(df).collect()
    assert sorted(r.doc_id for r in a) == sorted(r.doc_id for r in b)
    counts = defaultdict(int)
    for r in a:
        counts[r.doc_id] += 1
    assert max(counts.values()) <= 3
    t = source_mix.source_targets(df.select("source", source_mix.word_count(df["text"]).alias("size"))).collect()
    assert sum(r.target for r in t) == pytest.approx(sum(r.source_size for r in t))
    assert source_mix.mix(df.limit(0)).count() == 0


def test_bpe_matches_the_library(spark):
    from tokenizers import Tokenizer

    path = bpe.default_vocabulary()
    library, own = Tokenizer.from_file(path), bpe.WordBpe(path)
    for s in ["", "  ", "a<|startoftext|>B c's DON'T 123 ΣΑΣ", "é e", "日本語 text😀😀!!", "x" * 3000, "½ ² ١٢ \u0085y"]:
        ids = library.encode(s, add_special_tokens=False).ids
        assert own.encode(s) == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    got = {r.doc_id: r.n_tokens for r in bpe.digest(frame(spark, [(1, None), (2, "hello world")]), path).collect()}
    assert got == {1: 0, 2: 2}


def test_hidden_markov_likelihood_is_exact():
    model = hmm_score.Hmm.initial(np.array([5.0, 2.0, 1.0]), states=2)
    seqs = [np.array([0, 1, 2, 0], np.uint16), np.array([2, 2], np.uint16), np.array([1], np.uint16)]

    def brute(s):
        total = 0.0
        for path in np.ndindex(*[2] * len(s)):
            p = model.start[path[0]] * model.emit[s[0], path[0]]
            for t in range(1, len(s)):
                p *= model.move[path[t - 1], path[t]] * model.emit[s[t], path[t]]
            total += p
        return np.log10(total)

    assert model.log10(seqs) == pytest.approx([brute(s) for s in seqs])
    better = model.re_estimated(model.expected(seqs), prior=1e-12)
    assert better.log10(seqs).sum() >= model.log10(seqs).sum()


def test_hidden_markov_scores(spark):
    rows = [(i, f"the cat {'sat' if i % 2 else 'ran'} on w{i}") for i in range(60)] + [(99, None)]
    got = {r.doc_id: r for r in hmm_score.score(frame(spark, rows)).collect()}
    assert len(got) == 61 and got[99].n_tokens == 1 and got[0].n_tokens == 6
    train = [t for i, t in rows if not got[i].held_out]
    tokens = [w for t in train for w in WORD.findall(t or "")] + ["\n"] * len(train)
    assert got[0].train_tokens == len(tokens)
    c, n, v = defaultdict(int), len(tokens), len(set(tokens))
    for t in tokens:
        c[t] += 1
    assert got[0].base_score == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in [*rows[0][1].split(), "\n"]))


def test_quality_separates_classes(spark):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice(["the", "cat", "sat", "quietly", "there."]) for _ in range(40))
    bad = lambda: " ".join(rng.choice(["BUY!!", "###", "$$$", "NOW!!"]) for _ in range(40))
    rows = [(i, good() if i % 3 else bad()) for i in range(400)] + [(900, None), (901, "")]
    labels = spark.createDataFrame([(i, int(bool(i % 3))) for i in range(400)], "doc_id long, quality int")
    model = quality.fit(frame(spark, rows), labels)
    got = {r.doc_id: r._score for r in quality.scored(frame(spark, rows), model).collect()}
    assert sum((got[i] >= 0.7) == bool(i % 3) for i in range(400)) >= 390
    assert all(0 <= s <= 1 for s in got.values())


def removed_by_brute_force(rows):
    seen, want = set(), {}
    for i, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        want[i] = (sum(gone), bytes(x for x, g in zip(b, gone) if not g))
    return want


def test_suffix_dedup_of_anchors_that_fill_many_shards(spark):
    rng = random.Random(8)
    units = ["xyz0123", "alpha beta gamma delta ", "".join(rng.choice("abcd") for _ in range(130))]
    rows = [(i, f"{rng.random()}" * rng.randint(0, 3) + units[i % 3] * (20_000 // (i + 1)) + units[(i + 1) % 3][: rng.randint(0, 130)] * rng.randint(1, 200)) for i in range(12)]
    got = {r.doc_id: (r.n_removed, bytes(r.kept)) for r in suffix_dedup.without_repeats(frame(spark, rows)).collect()}
    assert got == removed_by_brute_force(rows)


def test_suffix_dedup_merges_runs_of_shards():
    rng = random.Random(9)
    stock = [bytes(rng.choice((0, 1, 65, 128, 255)) for _ in range(100)) for _ in range(40)]
    want, all_of, batches = {}, set(), []
    for doc in range(30):
        texts = sorted({rng.choice(stock) for _ in range(12)})
        data, start, text, first = suffix_dedup.survivors(texts)
        assert [bytes(data[p : p + 100]) for p in first] == texts
        th, at = rng.randint(-5, 5), rng.randint(0, 10**12)
        for t in texts:
            want[t] = min(want.get(t, (99, 0, 0)), (doc % 7, th, at))
            all_of.add((t, doc % 7, th, at))
        places = [np.full(len(first), doc % 7), np.full(len(first), th, np.int32), np.full(len(first), at)]
        batches += list(suffix_dedup.bucketed(data, first, tuple(places), 3))
    rows = sorted((r for b in batches for r in b.select(["bucket", "prefixes", "docs", "ths", "ats"]).to_pylist()), key=lambda r: r["bucket"])
    assert len({r["bucket"] for r in rows}) == 3
    schema = pa.schema([("bucket", pa.int64()), ("prefixes", pa.binary()), ("docs", pa.list_(pa.int64())), ("ths", pa.list_(pa.int32())), ("ats", pa.list_(pa.int64()))])
    cut = [pa.RecordBatch.from_pylist(rows[k : k + 7], schema) for k in range(0, len(rows), 7)]
    lost = [tuple(r.values()) for b in suffix_dedup._merge(iter(cut)) for r in b.to_pylist()]
    assert sorted(lost) == sorted((*p, 0) for t, *p in all_of if tuple(p) != want[t])


def test_suffix_dedup_splits_one_group_over_shards(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD", 1000)
    rng = random.Random(10)
    pieces = sorted((doc, 0, doc * 3, bytes(rng.choice(b"ab\xff") for _ in range(rng.randint(1, 4))) * 40 + b"c" * 100) for doc in range(60))
    pieces = [(d, t, a, raw[-130:]) for d, t, a, raw in pieces]
    names = ["h", "salt", "doc", "th", "at", "bytes"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    for salts in (1, 4):
        rows = sorted((5, 0 if salts == 1 else 1 + i % salts, *p) for i, p in enumerate(pieces))
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
        out = [r for b in suffix_dedup._shards(2)(iter([batch])) for r in b.to_pylist()]
        alive = {(r["doc"], r["at"] + k) for r in out if r["bucket"] is None for k in range(64) if r["alive"] >> k & 1}
        runs = sorted((r for r in out if r["bucket"] is not None), key=lambda r: r["bucket"])
        assert len(runs) > 2
        schema = pa.schema([("bucket", pa.int64()), ("prefixes", pa.binary()), ("docs", pa.list_(pa.int64())), ("ths", pa.list_(pa.int32())), ("ats", pa.list_(pa.int64()))])
        cut = pa.RecordBatch.from_pylist([{c: r[c] for c in schema.names} for r in runs], schema)
        lost = [(r["doc"], r["at"]) for b in suffix_dedup._merge(iter([cut])) for r in b.to_pylist()]
        assert lost and len(set(lost)) == len(lost) and alive.issuperset(lost)
        alive -= set(lost)
        want, seen = set(), set()
        for doc, _, at, raw in pieces:
            for k in range(len(raw) - 99):
                if raw[k : k + 100] not in seen:
                    seen.add(raw[k : k + 100])
                    want.add((doc, at + k))
        assert alive == want
