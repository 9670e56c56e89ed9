"""The pipeline against plain Python, stage by stage, and its tables without rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe, quality, secret_scan
from test_operators import WORD, brute_components, shingles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _gone string, _score string, kept string"


def documents():
    rng = random.Random(12)
    good = "the river ran quietly past an old mill and nobody in town could say when it had last turned".split()
    rows = []
    for i in range(300):
        if i % 4 == 3:
            text = " ".join(rng.choice(["BUY!!", "###", "$$$", "NOW!!", "0000"]) for _ in range(40))
        else:
            text = " ".join(rng.choice(good) for _ in range(50)) + "."
        if i % 20 == 8:
            text = rows[-4][1].replace("river", "stream", 1)
        if i % 30 == 6:
            text += " password=abcdefghijkl0123 and more"
        rows.append((i, text, None if i % 7 == 0 else "en", None if i % 11 == 0 else f"s{i % 4}", len(text), "g", "s", "k"))
    return [*rows, (900, None, None, "s0", None, None, None, None), (901, "", "en", "s1", 0, "", "", ""), rows[0]]


def test_every_stage(spark, tmp_path):
    rows = documents()
    labels = [(i, int(i % 4 != 3)) for i in range(300) if i % 5] + [(None, 1), (901, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    def stage(k, df):
        df.write.parquet(f"{tmp_path}/in{k}")
        out = corpus_pipeline.STAGES[k][1](spark, spark.read.parquet(f"{tmp_path}/in{k}"), str(tmp_path))
        assert k == 4 or out.columns == docs.columns
        return out

    # 1: the rows whose score reaches the cut, whole
    model = quality.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    scores = {r.doc_id: r.s for r in quality.scored(docs.select("doc_id", "text"), model).select("doc_id", F.col("_score").alias("s")).collect()}
    first = stage(0, docs)
    kept = [tuple(r) for r in first.collect()]
    assert Counter(kept) == Counter(r for r in rows if scores[r[0]] >= 0.7)
    assert all(r[0] % 4 != 3 or r[0] >= 900 for r in kept) and sum(r[0] % 4 != 3 for r in kept) > 200

    # 2: one document of each group of similarity 0.8
    sets = {r[0]: shingles(r[1]) for r in kept}
    root = brute_components(sets, lambda a, b: a and b and 10 * len(a & b) >= 8 * len(a | b))
    second = stage(1, first)
    unique = [tuple(r) for r in second.collect()]
    assert Counter(unique) == Counter(r for r in kept if root[r[0]] == r[0]) and len(unique) < len(kept)

    # 3: secrets replaced, n_chars counted anew
    secrets = secret_scan.train(secret_scan.training_samples(spark.createDataFrame(unique, SCHEMA)))
    spans = {r.doc_id: r.at for r in secret_scan.scan(spark.createDataFrame(unique, SCHEMA).select("doc_id", "text"), secrets).select("doc_id", F.expr("transform(_spans, s -> array(s.start, s.end))").alias("at")).collect()}

    def redacted(row):
        text = row[1]
        at = [False] * len(text or "")
        for a, b in spans[row[0]]:
            at[a:b] = [True] * (b - a)
        if not any(at):
            return row
        out = "".join("\0" if x else c for c, x in zip(text, at))
        out = re.sub("\0+", "[SECRET]", out)
        return (row[0], out, *row[2:4], len(out), *row[5:])

    third = stage(2, second)
    clean = [tuple(r) for r in third.collect()]
    assert Counter(clean) == Counter(map(redacted, unique)) and any("[SECRET]" in (r[1] or "") for r in clean)

    # 4: targets by water filling, copies drawn from a hash of the id
    size = {r: len(WORD.findall(r[1] or "")) for r in clean}
    total = defaultdict(int)
    for r in clean:
        total[r[3]] += size[r]
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight, target, free = {s: 1 + k % 3 for k, s in enumerate(names)}, {}, set(names)
    while free:
        level = (sum(total.values()) - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * total[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 3 * total[s] for s in over}
        free -= over
    copies = Counter()
    for r in clean:
        rate = target[r[3]] / total[r[3]] if total[r[3]] else 0
        u = int(hashlib.md5(f"mix:{r[0]}".encode()).hexdigest()[:13], 16) / (1 << 52)
        copies[r] += int(rate) + (u < rate - int(rate))
    fourth = stage(3, third)
    assert Counter(tuple(r) for r in fourth.collect()) == Counter({r: n for r, n in copies.items() if n})

    # 5: the library's ids, and the same rows from run()
    library = Tokenizer.from_file(bpe.default_vocabulary())
    want = Counter()
    for r, n in copies.items():
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want[(r[0], r[3], len(ids), tuple(ids))] += n
    rows_of = lambda df: Counter((r.doc_id, r.source, r.n_tokens, tuple(r.ids)) for r in df.collect())
    assert rows_of(stage(4, fourth)) == rows_of(corpus_pipeline.run(spark, str(tmp_path))) == +want


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "source", "n_tokens", "ids"] and out.count() == 0
