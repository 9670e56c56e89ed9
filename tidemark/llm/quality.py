"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Statistics are standardised and sent through cosines of random projections, which approximate a Gaussian kernel. Each
partition sums its part of the normal equations; the driver adds a fixed number of parts, solves for the weights, and
fits an isotonic curve on rows the weights have not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import _LOWER, byte_view, extended, materialize, pieces, prefix_hash, shielded, substring_hash, table, word_hashes

#: Labelled rows that are learnt from, at most: those whose id hashes lowest.
MOST_LABELLED = 40_000
#: Random features, ridge penalty for each row, parts of the normal equations, bins of the calibration, cut of predicted.
FEATURES, RIDGE, PARTS, BINS, CUT = 256, 1e-4, 16, 512, 0.7
PIECE = 1 << 20
_SEED = 5
_UPPER, _LETTER, _DIGIT = np.zeros(256), np.zeros(256), np.zeros(256)
_UPPER[65:91] = _LETTER[65:91] = _LETTER[97:123] = _DIGIT[48:58] = 1
_MARK = np.zeros(256)
for _a, _b in ((33, 48), (58, 65), (91, 97), (123, 127)):
    _MARK[_a:_b] = 1
N_STATISTICS = 26


def lines_of(raw: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """A hash of every line; edges: where lines begin, and the end."""
    prefix = prefix_hash(raw)
    return substring_hash(prefix, edges[:-1], np.maximum(edges[1:] - 1, edges[:-1]))


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of N_STATISTICS numbers for each text; all of a text counts. An empty text gives zeros."""
    n = len(offsets) - 1
    out = np.zeros((n, N_STATISTICS))
    start, end, doc, h = word_hashes(data, offsets)
    first = np.searchsorted(doc, np.arange(n + 1))
    length = end - start
    low = _LOWER[data]
    capital = (data[start] != low[start]).astype(float) if len(start) else np.zeros(0)
    closing = data[end - 1] if len(end) else np.zeros(0, np.uint8)
    shout = np.zeros(len(start))
    if len(start):
        ups = np.concatenate([[0], np.cumsum(_UPPER[data])])
        shout = ((ups[end] - ups[start]) >= 0.6 * length) & (length > 1)
    for i in range(n):
        a, b = offsets[i], offsets[i + 1]
        p, q = first[i], first[i + 1]
        size, m = b - a, q - p
        if not m:
            out[i, 0] = np.log1p(size)
            continue
        raw = data[a:b]
        byte = np.bincount(raw, minlength=256)
        letters = max(byte @ _LETTER, 1)
        x = h[p:q]
        distinct, times = np.unique(x, return_counts=True)
        lines = np.flatnonzero(raw == 10)
        edges = np.r_[0, lines + 1, size]
        line_sizes = np.diff(edges)
        pairs = x[:-1] * np.uint64(3) + x[1:] if m > 1 else x
        lens = length[p:q]
        ends = closing[p:q]
        marks = byte * _MARK
        keys = lines_of(raw, edges)
        out[i] = (
            np.log1p(size), np.log1p(m), lens.mean(), lens.std(), (lens <= 3).mean(), (lens > 14).mean(),
            byte @ _UPPER / letters, byte @ _DIGIT / size, marks.sum() / size, (size - byte[:128].sum()) / size,
            capital[p:q].mean(), shout[p:q].mean(), len(distinct) / m, times.max() / m, (times > 1).mean(), (x[1:] == x[:-1]).mean() if m > 1 else 0,
            len(np.unique(pairs)) / len(pairs), np.log1p(len(lines)), np.log1p(line_sizes.mean()), len(np.unique(keys)) / len(keys),
            np.isin(ends, (46, 44, 59, 58, 63)).mean(), (ends == 46).mean(), byte[33] / m, byte[124] / m, (byte[35] + byte[36] + byte[37] + byte[38] + byte[42]) / m, marks.max() / max(marks.sum(), 1),
        )
    return out


@dataclass
class Quality:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    curve: tuple[np.ndarray, np.ndarray]

    @staticmethod
    def projection(features: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
        """Frequencies of a Gaussian kernel whose width is the square root of the number of statistics, and phases."""
        rng = np.random.default_rng(_SEED)
        return rng.normal(0, 1 / np.sqrt(N_STATISTICS), (N_STATISTICS, features)), rng.uniform(0, 2 * np.pi, features)

    @staticmethod
    def features(stats: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
        """Cosine features, and a constant."""
        w, b = Quality.projection()
        x = np.clip((stats - mean) / spread, -6, 6)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(x @ w + b), np.ones((len(x), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats, self.mean, self.spread) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), *self.curve), 0, 1)


def isotonic(x: np.ndarray, total: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rising curve nearest to total / weight at the points x (pool adjacent violators): its knots."""
    blocks: list[list[float]] = []
    for a, t, w in zip(x, total, weight, strict=True):
        blocks.append([a, a, t, w])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            _, hi, t2, w2 = blocks.pop()
            blocks[-1][1] = hi
            blocks[-1][2] += t2
            blocks[-1][3] += w2
    xs = [v for b in blocks for v in ((b[0], b[1]) if b[1] > b[0] else (b[0],))]
    ys = [b[2] / b[3] for b in blocks for _ in range(2 if b[1] > b[0] else 1)]
    return np.array(xs), np.array(ys)


def _sums(frame: DataFrame, columns: int, row) -> np.ndarray:
    """The sum over partitions of what row(statistics, labels) returns; PARTS vectors reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(columns)
        for batch in batches:
            if batch.num_rows:
                stats = np.frombuffer(b"".join(batch.column(0).to_pylist()), float).reshape(-1, N_STATISTICS)
                total += row(stats, batch.column(1).to_numpy(zero_copy_only=False).astype(float))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

    rows = frame.select("stats", "y").coalesce(PARTS).mapInArrow(run, "s binary").collect()
    return np.sum([np.frombuffer(r["s"]) for r in rows], axis=0) if rows else np.zeros(columns)


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep..., stats (N_STATISTICS doubles as bytes). docs: keep..., text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_view(batch.column(len(keep)))
            for lo, hi in pieces(offsets, PIECE):
                stats = statistics(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(lo, hi - lo) for i in range(len(keep))], pa.array([r.tobytes() for r in stats], pa.binary())], [*keep, "stats"])

    slim = docs.select(*keep, "text")
    return slim.mapInArrow(run, slim.drop("text").schema.add("stats", "binary"))


def fold(doc_id: Column) -> Column:
    """crc32 of the id's text modulo 4; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4, F.lit(-1)).cast("int")


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Quality:
    """Learn from labelled documents outside fold 2: folds 0 and 1 give the weights, fold 3 the calibration.

    docs: doc_id, text; labels: doc_id, quality (0 or 1; rows with a null in either are left out). Without labelled
    rows, or with one class only, the curve is flat at that class's share (1 without any).
    """
    chosen = labels.select("doc_id", F.col("quality").cast("double").alias("y")).dropna().where(fold(F.col("doc_id")) != 2)
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    stats = materialize(with_statistics(found.select("doc_id", "y", "text"), ["doc_id", "y"]).withColumn("fold", fold(F.col("doc_id"))), "labelled")
    weight_rows, curve_rows = stats.where("fold <> 3"), stats.where("fold = 3")
    d, k = N_STATISTICS, FEATURES + 1
    moments = _sums(weight_rows, 2 * d + 1, lambda s, y: np.concatenate([[len(s)], s.sum(axis=0), (s * s).sum(axis=0)]))
    n = max(moments[0], 1)
    mean = moments[1 : d + 1] / n
    spread = np.sqrt(np.maximum(moments[d + 1 :] / n - mean**2, 0)) + 1e-6

    def equations(s: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = Quality.features(s, mean, spread)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    sums = _sums(weight_rows, k * k + k, equations)
    a = sums[: k * k].reshape(k, k) + np.eye(k) * (RIDGE * n + 1e-9)
    model = Quality(mean, spread, np.linalg.solve(a, sums[k * k :]), (np.array([0.0]), np.array([1.0])))

    def histogram(s: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = np.clip(((model.raw(s) + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(at, weights=y, minlength=BINS), np.bincount(at, minlength=BINS)])

    total, weight = np.split(_sums(curve_rows, 2 * BINS, histogram), 2)
    seen = np.flatnonzero(weight)
    if len(seen):
        model.curve = isotonic((seen + 0.5) / BINS * 2 - 0.5, total[seen], weight[seen])
    return model


def scored(docs: DataFrame, model: Quality) -> DataFrame:
    """docs with _score, as double. Every column but the text is passed on unread; a null or empty text has a score too.

    An empty table gives no rows. A column of docs named _score gives way.
    """
    return shielded(docs, ["text"], lambda d: _scored(d, model))


def _scored(docs: DataFrame, model: Quality) -> DataFrame:
    keep = docs.columns
    at = keep.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_view(batch.column(at))
            parts = [model.score(statistics(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])) for lo, hi in pieces(offsets, PIECE)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(parts) if parts else np.zeros(0))], [*keep, "_score"])

    return docs.mapInArrow(run, extended(docs.schema, "_score double"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scored(docs, fit(docs, table(spark, sf_dir, "labels"))).drop("text")
    return found.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= CUT).cast("int").alias("predicted"))
