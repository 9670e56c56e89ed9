"""LM scoring with a hidden Markov model over words.

A latent state emits a word class and the class emits a word: P(word | state) = e[state, class] * (c + 1) / (N + V + 1),
with c the word's training count and N, V the tokens and distinct words of its class, one slot kept for unseen words.
Frequent words are classes of their own; the others share classes by their last two bytes; the end of a text is one.
Baum-Welch: each partition sums expected counts over its training texts, the sums meet in one small aggregate, and the
re-estimated parameters go out again. Long texts are worked on in segments at once; products of transfer matrices carry
the forward and backward messages across the cuts, so the sums are those of whole texts. A text's likelihood is exact: scaled forward recursion over the whole text.
Word counts are a distributed table as large as the vocabulary; only a head of fixed size travels with the tasks, and
words beyond it meet their counts in a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import _LOWER, byte_view, materialize, mix64, pieces, table, word_hashes

STATES, ROUNDS = 6, 3
#: Words that are classes of their own, classes for the rest, and words whose counts go out with the tasks.
OWN_CLASSES, SHARED_CLASSES, HEAD_WORDS = 1000, 509, 200_000
#: Training works on segments of this many tokens, joined by messages over their borders; tokens of texts held at once.
SEGMENT, HELD_TOKENS = 512, 1 << 19
PIECE = 2 << 20
#: The hash that stands for the end of a text.
END = np.uint64(0x5EED)
_SEED = 11


def held_out(doc_id: Column, modulus: int = 7, rest: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == rest, F.lit(False))


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, shared class, text) of every token in order, each text closed by END."""
    start, end, doc, h = word_hashes(data, offsets)
    low = _LOWER[data]
    tail = low[end - 1].astype(np.uint64) * np.uint64(256) + np.where(end - start > 1, low[np.maximum(end - 2, 0)], 0).astype(np.uint64) if len(start) else np.zeros(0, np.uint64)
    shared = (mix64(tail) % np.uint64(SHARED_CLASSES)).astype(np.int64)
    n = len(offsets) - 1
    counts = np.bincount(doc, minlength=n)
    at = np.cumsum(counts) + np.arange(n)
    hashes, classes, docs = np.zeros(len(h) + n, np.uint64), np.zeros(len(h) + n, np.int64), np.repeat(np.arange(n), counts + 1)
    word = np.ones(len(hashes), bool)
    word[at] = False
    hashes[word], hashes[at] = h, END
    classes[word], classes[at] = shared, SHARED_CLASSES
    return hashes, classes, docs


def word_counts(docs: DataFrame) -> DataFrame:
    """h, shared, c: the count of every distinct token of docs (text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_view(batch.column(0))
            for lo, hi in pieces(offsets, 2 * PIECE):
                h, shared, _ = _tokens(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                u, first, c = np.unique(h, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(shared[first].astype(np.int32)), pa.array(c.astype(np.int64))], ["h", "shared", "c"])

    return docs.select("text").mapInArrow(run, "h long, shared int, c long").groupBy("h").agg(F.first("shared").alias("shared"), F.sum("c").alias("c"))


def encoded(docs: DataFrame, head: tuple[np.ndarray, np.ndarray], own: np.ndarray, log_den: np.ndarray) -> DataFrame:
    """Rows of two kinds. Texts (h null): key, doc_id, held, n, known, sum, den, classes. Rare words: key, h, n (times).

    sum: log10(c + 1) over the tokens in the head; den: log10 of the classes' denominators over all tokens.
    """
    head_h, head_c = head
    own_order = np.argsort(own)
    own_sorted = own[own_order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = np.log10(head_c + 1.0)
        for batch in batches:
            data, offsets = byte_view(batch.column(3))
            for lo, hi in pieces(offsets, PIECE):
                h, shared, doc = _tokens(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                n, m = hi - lo, len(h)
                at = np.minimum(np.searchsorted(own_sorted, h), len(own_sorted) - 1) if len(own_sorted) else np.zeros(m, np.int64)
                is_own = own_sorted[at] == h if len(own_sorted) else np.zeros(m, bool)
                classes = np.where(is_own, own_order[at] if len(own_sorted) else 0, OWN_CLASSES + shared).astype(np.uint16)
                at = np.minimum(np.searchsorted(head_h, h), max(len(head_h) - 1, 0))
                hit = head_h[at] == h if len(head_h) else np.zeros(m, bool)
                size = np.bincount(doc, minlength=n)
                ends = np.cumsum(size)
                cut = [classes[e - s : e].tobytes() for s, e in zip(size, ends, strict=True)]
                sums = np.bincount(doc[hit], weights=logs[at[hit]], minlength=n) if len(head_h) else np.zeros(n)
                own_cols = [batch.column(i).slice(lo, n) for i in range(3)]
                none = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays([*own_cols, none, pa.array(size.astype(np.int64)), pa.array(np.bincount(doc[hit], minlength=n).astype(np.int64)), pa.array(sums), pa.array(np.bincount(doc, weights=log_den[classes], minlength=n)), pa.array(cut, pa.binary())], names)
                rare_h, rare_doc = h[~hit], doc[~hit]
                if len(rare_h):
                    order = np.lexsort((rare_h, rare_doc))
                    rare_h, rare_doc = rare_h[order], rare_doc[order]
                    first = np.flatnonzero(np.r_[True, (rare_h[1:] != rare_h[:-1]) | (rare_doc[1:] != rare_doc[:-1])])
                    times = np.diff(np.r_[first, len(rare_h)])
                    keys = own_cols[0].to_numpy()[rare_doc[first]]
                    k = len(first)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.nulls(k, own_cols[1].type), pa.nulls(k, pa.bool_()), pa.array(rare_h[first].view(np.int64)), pa.array(times.astype(np.int64)), pa.nulls(k, pa.int64()), pa.nulls(k, pa.float64()), pa.nulls(k, pa.float64()), pa.nulls(k, pa.binary())], names)

    names = ["key", "doc_id", "held", "h", "n", "known", "sum", "den", "classes"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    slim = docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", held_out(F.col("doc_id")).alias("held"), "text")
    return slim.mapInArrow(run, f"key long, doc_id {kind}, held boolean, h long, n long, known long, sum double, den double, classes binary")


def head(counts: DataFrame, most: int = HEAD_WORDS) -> DataFrame:
    """The words of highest count, `most` or fewer: those from the lowest eighth of an octave on that leaves so few."""
    octave = F.floor(F.log2("c") * 8).cast("int")
    sizes = counts.groupBy(octave.alias("o")).count().collect()  # a few hundred rows
    cut, total = 1 << 20, 0
    for row in sorted(sizes, key=lambda r: -r["o"]):
        total += row["count"]
        if total > most:
            break
        cut = row["o"]
    return counts.where(octave >= cut)


class Hmm:
    """Parameters: start [K], move [K, K], emit [classes, K] (each column sums to 1)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @staticmethod
    def initial(class_counts: np.ndarray, states: int = STATES, seed: int = _SEED) -> Hmm:
        rng = np.random.default_rng(seed)
        emit = (class_counts[:, None] + 1.0) * np.exp(rng.normal(0, 1, (len(class_counts), states)))
        move = np.full((states, states), 1.0) + 4 * np.eye(states)
        return Hmm(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))

    def re_estimated(self, sums: np.ndarray, prior: float = 0.01) -> Hmm:
        c, k = self.emit.shape
        start, move, emit = np.split(sums, [k, k + k * k])
        start, move, emit = start + prior, move.reshape(k, k) + prior, emit.reshape(c, k) + prior
        return Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))

    def _padded(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """[T, B] classes and lengths; texts in order of falling length, so the first b rows are those still running."""
        lengths = np.array([len(t) for t in texts])
        out = np.zeros((lengths[0], len(texts)), np.int64)
        for i, t in enumerate(texts):
            out[: len(t), i] = t
        return out, lengths

    def log10(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 likelihood of each class sequence; texts in order of falling length."""
        total = np.zeros(len(texts))
        lengths = np.array([len(t) for t in texts])
        a = None
        for t in range(lengths[0] if len(texts) else 0):
            b = int(np.searchsorted(-lengths, -t, side="left"))
            x = self.emit[np.fromiter((s[t] for s in texts[:b]), np.int64, b)] if b < 8 else self.emit[self._column(texts, t, b)]
            a = self.start * x if a is None else (a[:b] @ self.move) * x
            scale = a.sum(axis=1)
            a /= scale[:, None]
            total[:b] += np.log10(scale)
        return total

    def _column(self, texts: list[np.ndarray], t: int, b: int) -> np.ndarray:
        """Classes at position t, from strips of 64 positions."""
        at = t // 64
        if getattr(self, "_strip_at", None) != (id(texts), at):
            strip = np.zeros((64, b), np.int64)
            for i in range(b):
                part = texts[i][at * 64 : at * 64 + 64]
                strip[: len(part), i] = part
            self._strip, self._strip_at = strip, (id(texts), at)
        return self._strip[t - at * 64, :b]

    def spans(self, segments: list[np.ndarray]) -> np.ndarray:
        """[n, K, K], up to a factor: a segment's words and its last state, given its first; in order of falling length."""
        k = self.emit.shape[1]
        classes, lengths = self._padded(segments)
        live = np.searchsorted(-lengths, -np.arange(len(classes)), side="left")
        out = np.zeros((len(segments), k, k))
        out[:, np.arange(k), np.arange(k)] = self.emit[classes[0]]
        for t in range(1, len(classes)):
            b = live[t]
            out[:b] = (out[:b].reshape(-1, k) @ self.move).reshape(b, k, k) * self.emit[classes[t, :b]][:, None, :]
            if t % 16 == 0:
                out[:b] /= out[:b].max(axis=(1, 2), keepdims=True)
        return out / out.max(axis=(1, 2), keepdims=True)

    def borders(self, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each segment of one text, in order: the state before it (0 for the first), what follows it by its last state."""
        n, k = len(spans), self.emit.shape[1]
        before, after = np.zeros((n, k)), np.ones((n, k))
        enter = self.start
        for s in range(n - 1):
            a = enter @ spans[s]
            before[s + 1] = a / a.sum()
            enter = before[s + 1] @ self.move
        for s in range(n - 1, 0, -1):
            b = self.move @ (spans[s] @ after[s])
            after[s - 1] = b / b.max()
        return before, after

    def expected(self, texts: list[np.ndarray], before: np.ndarray | None = None, after: np.ndarray | None = None) -> np.ndarray:
        """Expected counts (start, move, emit) of the class sequences, flat; texts in order of falling length.

        before, after: borders(), where the sequences are segments of longer ones.
        """
        c, k = self.emit.shape
        classes, lengths = self._padded(texts)
        steps, n = classes.shape
        before = np.zeros((n, k)) if before is None else before
        first = ~before.any(axis=1)
        live = np.searchsorted(-lengths, -np.arange(steps), side="left")
        alpha, scale = np.zeros((steps, n, k)), np.ones((steps, n))
        for t in range(steps):
            b = live[t]
            a = self.emit[classes[t, :b]] * (np.where(first[:, None], self.start, before @ self.move) if t == 0 else alpha[t - 1, :b] @ self.move)
            scale[t, :b] = a.sum(axis=1)
            alpha[t, :b] = a / scale[t, :b, None]
        move = np.zeros((k, k))
        beta = np.ones((n, k))
        if after is not None:
            beta = after / (alpha[lengths - 1, np.arange(n)] * after).sum(axis=1, keepdims=True)
        for t in range(steps - 1, 0, -1):
            b = live[t]
            back = self.emit[classes[t, :b]] * beta[:b] / scale[t, :b, None]
            move += alpha[t - 1, :b].T @ back
            alpha[t, :b] *= beta[:b]
            beta[:b] = back @ self.move.T
        move += before.T @ (self.emit[classes[0]] * beta / scale[0, :, None])
        alpha[0] *= beta
        mask = np.arange(steps)[:, None] < lengths[None, :]
        seen, gamma = classes[mask], alpha[mask]
        emit = np.stack([np.bincount(seen, weights=gamma[:, i], minlength=c) for i in range(k)], axis=1)
        return np.concatenate([alpha[0][first].sum(axis=0), (move * self.move).ravel(), emit.ravel()])

    def counted(self, texts: list[np.ndarray], segment: int | None = None, most: int = 1024) -> np.ndarray:
        """expected() of whole texts of any length and order, `most` segments at a time.

        A segment meets the rest of its text through borders(), so the sums are those of the uncut text.
        """
        k, segment = self.emit.shape[1], segment or SEGMENT
        parts = [x[i : i + segment] for x in texts for i in range(0, len(x), segment)]
        sizes = np.array([-(-len(x) // segment) for x in texts])
        ends = np.cumsum(sizes)
        before, after = np.zeros((len(parts), k)), np.ones((len(parts), k))
        order = np.argsort([-len(x) for x in parts], kind="stable")
        cut = np.repeat(sizes > 1, sizes)
        spans = np.zeros((len(parts), k, k))
        chosen = order[cut[order]]
        for i in range(0, len(chosen), most):
            at = chosen[i : i + most]
            spans[at] = self.spans([parts[j] for j in at])
        for lo, hi in zip((ends - sizes)[sizes > 1], ends[sizes > 1], strict=True):
            before[lo:hi], after[lo:hi] = self.borders(spans[lo:hi])
        total = np.zeros(k + k * k + self.emit.size)
        for i in range(0, len(order), most):
            at = order[i : i + most]
            total += self.expected([parts[j] for j in at], before[at], after[at])
        return total


def baum_welch(sequences: DataFrame, model: Hmm) -> Hmm:
    """One round over all sequences (classes: uint16 as bytes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        waiting: list[np.ndarray] = []
        tokens = 0
        for batch in batches:
            for raw in batch.column(0):
                waiting.append(np.frombuffer(raw.as_buffer(), np.uint16))
                tokens += len(waiting[-1])
                if tokens >= HELD_TOKENS:
                    got = model.counted(waiting)
                    total = got if total is None else total + got
                    waiting, tokens = [], 0
        if waiting:
            got = model.counted(waiting)
            total = got if total is None else total + got
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["at", "v"])

    summed = sequences.select("classes").mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v"))
    k = model.emit.shape[1]
    sums = np.zeros(k + k * k + model.emit.size)
    for row in summed.collect():  # as many rows as the model has parameters
        sums[row["at"]] = row["v"]
    return model.re_estimated(sums)


def _scored(texts: DataFrame, model: Hmm) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [np.frombuffer(raw.as_buffer(), np.uint16) for raw in batch.column(1)]
            order = sorted(range(len(x)), key=lambda i: -len(x[i]))
            out = np.zeros(len(x))
            for i in range(0, len(order), 2048):
                part = order[i : i + 2048]
                out[part] = model.log10([x[j] for j in part])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["key", "hidden"])

    return texts.select("key", "classes").mapInArrow(run, "key long, hidden double")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, states: int = STATES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    A null or empty text is one end token. A null id is not held out. Words are told apart by a 64-bit hash. Without
    training texts every count is 0 and base_score is n_tokens * log10(1 / 1). Other columns are not read.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counts = materialize(word_counts(docs.where(~held_out(F.col("doc_id")))), "counts")
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = head(counts).toArrow()
    head_h, head_c = top.column("h").to_numpy().view(np.uint64), top.column("c").to_numpy()
    rank = np.lexsort((head_h.view(np.int64), -head_c))[: OWN_CLASSES]
    own = head_h[rank]
    own = own[own != END]
    is_own = F.col("h").isin([int(x) for x in own.view(np.int64)]) if len(own) else F.lit(False)
    n_classes = OWN_CLASSES + SHARED_CLASSES + 1
    class_tokens, class_words = np.zeros(n_classes), np.zeros(n_classes)
    for row in counts.where(~is_own).groupBy("shared").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        class_tokens[OWN_CLASSES + row["shared"]], class_words[OWN_CLASSES + row["shared"]] = row["c"], row["v"]
    by_hash = dict(zip(head_h.tolist(), head_c.tolist(), strict=True))
    for i, h in enumerate(own.tolist()):
        class_tokens[i], class_words[i] = by_hash[h], 1
    order = np.argsort(head_h)
    coded = materialize(encoded(docs, (head_h[order], head_c[order]), own, np.log10(class_tokens + class_words + 1)), "encoded")
    texts = coded.where("h IS NULL")
    model = Hmm.initial(class_tokens, states)
    training = texts.where("NOT held")
    for _ in range(rounds):
        model = baum_welch(training, model)
    rare = coded.where("h IS NOT NULL").select("key", "h", "n").join(counts.select("h", "c"), "h", "left")
    rare = rare.groupBy("key").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"), F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("rare_sum"))
    joined = texts.drop("classes").join(_scored(texts, model), "key").join(rare, "key", "left")
    words = F.col("sum") + F.coalesce("rare_sum", F.lit(0.0))
    return joined.select(
        "doc_id", F.col("held").alias("held_out"), F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"), (words - F.col("n") * float(np.log10(tokens + distinct + 1))).alias("base_score"),
        (F.col("hidden") + words - F.col("den")).alias("score"),
    )


def op5_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
