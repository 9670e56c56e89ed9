"""BPE encoding and decoding: a priority queue of merge ranks over a doubly linked list of symbols.

The vocabulary file (tokenizers JSON) is a parameter; its path must exist on every executor, as the libraries do.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import byte_view, extended, pieces, shielded, table

#: Words in a worker's cache at most, and those that stay, the first met, when it is full or a partition ends.
CACHE_WORDS, CACHE_KEPT = 300_000, 60_000
#: Bytes of text whose ids are held at once.
PIECE = 1 << 20
#: Words longer than this are encoded without the cache.
CACHED_LENGTH = 48


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 ones for themselves, the rest from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(spare)) for b in range(256)]


class WordBpe:
    """An encoder for a tokenizers JSON with NFC, white-space and lower-case normalizers, a split pattern and byte symbols."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.suffix = model["end_of_word_suffix"] or ""
        self.rank: dict[tuple[str, str], int] = {}
        for i, pair in enumerate(model["merges"]):
            self.rank[tuple(pair if isinstance(pair, list) else pair.split(" "))] = i
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(split.replace(r"\s", r"\p{White_Space}"), regex.V0)
        self.space = regex.compile(r"\p{White_Space}+")
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.bytes = byte_alphabet()
        self.texts = {str(i): t for i, t in self.names.items()}
        self.cache: dict[str, str] = {}

    def trim(self) -> None:
        if len(self.cache) > CACHE_KEPT:
            self.cache = dict(islice(self.cache.items(), CACHE_KEPT))

    def merge(self, symbols: list[str]) -> list[str]:
        """Merge the pair of lowest rank, leftmost first. Queue entries made stale by an earlier merge are skipped."""
        n, rank = len(symbols), self.rank
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        after[-1] = -1
        queue = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := rank.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(queue)
        alive = [True] * n
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i]
            if not alive[i] or j < 0 or symbols[i] != left or symbols[j] != right:
                continue
            symbols[i] = left + right
            alive[j] = False
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank.get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(queue, (r, i, symbols[i], symbols[k]))
            h = before[i]
            if h >= 0 and (r := rank.get((symbols[h], symbols[i]))) is not None:
                heapq.heappush(queue, (r, h, symbols[h], symbols[i]))
        return [s for s, a in zip(symbols, alive, strict=True) if a]

    def word(self, text: str) -> str:
        """The ids, as text, of one word of the split pattern."""
        got = self.cache.get(text)
        if got is None:
            symbols = [self.bytes[b] for b in text.encode("utf-8")]
            symbols[-1] += self.suffix
            got = " ".join([str(self.vocab[t]) for t in self.merge(symbols) if t in self.vocab])
            if len(text) <= CACHED_LENGTH:
                if len(self.cache) >= CACHE_WORDS:
                    self.trim()
                self.cache[text] = got
        return got

    def normalized(self, text: str) -> str:
        text = self.space.sub(" ", unicodedata.normalize("NFC", text))
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()

    def ids_text(self, text: str) -> str:
        """Decimal ids of words and special tokens in order, joined by a blank."""
        at, out = 0, []
        for mark in self.marks.finditer(text) if self.marks and "<|" in text else ():
            out += map(self.word, self.split.findall(self.normalized(text[at : mark.start()])))
            out.append(str(self.special[mark[0]]))
            at = mark.end()
        out += map(self.word, self.split.findall(self.normalized(text[at:] if at else text)))
        return " ".join(filter(None, out))

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.ids_text(text).split()]

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings joined by a blank, as the file names no decoder; ids it doesn't have are skipped."""
        return " ".join(self.names[i] for i in ids if i in self.names)


@lru_cache(maxsize=2)
def encoder(path: str) -> WordBpe:
    return WordBpe(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, vocabulary: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """docs with a column of token ids (array of int). A null or empty text has no tokens.

    Other columns stay as they are; one that is named like the result gives way to it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for lo, hi in pieces(byte_view(batch.column(at))[1], PIECE):
                part = batch.slice(lo, hi - lo)
                ids = [np.array(bpe.ids_text(t.as_py() or "").split(), np.int32) for t in part.column(at)]
                offsets = pa.array(np.r_[0, np.cumsum([len(x) for x in ids])], pa.int32())
                flat = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([*part.columns, flat], [*batch.schema.names, out])
        bpe.trim()

    return shielded(docs, [text_col], lambda d: d.mapInArrow(run, extended(d.schema, f"{out} array<int>")))


def decode(docs: DataFrame, vocabulary: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with the text that the ids decode to; null ids give an empty text. A column named like the result gives way."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in batches:
            at = batch.schema.get_field_index(ids_col)
            text = pa.array([bpe.decode(x or []) for x in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, text], [*batch.schema.names, out])

    return shielded(docs, [ids_col], lambda d: d.mapInArrow(run, extended(d.schema, f"{out} string")))


def digest(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    One map over the scan, no shuffle. A null text counts as empty; the digests are then those of the empty string.
    """
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in batches:
            n, ids, decoded = [], [], []
            for text in batch.column(1):
                joined = bpe.ids_text(text.as_py() or "")
                each = joined.split()
                n.append(len(each))
                ids.append(sha(joined))
                decoded.append(sha(" ".join([bpe.texts[i] for i in each])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        bpe.trim()

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"), default_vocabulary())
