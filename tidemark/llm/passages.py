"""Repeated passages: windows of WORDS words that also stand elsewhere, wherever lines break and whatever surrounds them.

1. Each window has a content-defined anchor, the smallest hash of the GRAM-word grams in it, so equal windows share it
   however they are wrapped. Anchors seen twice or more, outside of lines that are removed anyway, set bits in op7's filter of
   fixed size; a false bit only costs work.
2. Windows whose anchor may repeat are compared by 64-bit hashes of all their words (A-Z lower-cased, spacing ignored).
   The first of equal ones stays, the others are repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import byte_view, materialize, mix64, pieces, powers, release, word_hashes, words
from tidemark.llm.suffix_dedup import _filter, _may_repeat

#: Words of a passage, and of the gram that is hashed at each word.
WORDS, GRAM = 50, 26
#: Bytes of text handled at once; windows of one row of the second pass.
PIECE, CHUNK = 1 << 18, 4096


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(place of its first word in all, anchor's hash, own hash) of every window, and (start, text, words before it) of every word and text."""
    start, _, text, h = word_hashes(data, offsets)
    before = np.searchsorted(text, np.arange(len(offsets)))
    n = len(h)
    if n < WORDS:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), start, text, before
    up, down = powers(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(h * up[:n], out=prefix[1:])
        best = mix64((prefix[GRAM:] - prefix[:-GRAM]) * down[: n - GRAM + 1])
        own = mix64((prefix[WORDS:] - prefix[:-WORDS]) * down[: n - WORDS + 1] + np.uint64(WORDS))
    width, span = 1, WORDS - GRAM + 1
    while 2 * width <= span:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if width < span:
        best = np.minimum(best[: width - span], best[span - width :])
    at = np.flatnonzero(text[: n - WORDS + 1] == text[WORDS - 1 :])
    return at, best[at], own[at], start, text, before


def _grouped(values: list[np.ndarray], doc: np.ndarray) -> tuple[pa.Array, list[pa.Array]]:
    """(document of each row, lists): the values by document, at most CHUNK in a row; doc is sorted."""
    heads = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (np.arange(1, len(doc)) % CHUNK == 0)])
    cuts = pa.array(np.r_[heads, len(doc)].astype(np.int32))
    return doc[heads], [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in values]


def _lines(part: np.ndarray, ends: np.ndarray, start: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The line of its text that each word stands in, from 0."""
    breaks = np.r_[0, np.cumsum(part == 10)]
    return (breaks[start] - breaks[ends[text]]).astype(np.int32)


def _removed_lines(lo: np.ndarray, hi: np.ndarray, size: np.ndarray, gone: pa.Array) -> np.ndarray:
    """How many of the lines lo to hi are removed; size: entries of each row, gone: removed lines of each row."""
    edges, out = np.r_[0, np.cumsum(size)], np.zeros(len(lo), np.int64)
    for i, places in enumerate(gone):
        a, b = edges[i], edges[i + 1]
        if b > a and places.values is not None and len(places.values):
            at = places.values.to_numpy()
            sums = np.zeros(max(int(hi[a:b].max()), int(at.max())) + 2, np.int64)
            sums[at + 1] = 1
            sums = np.cumsum(sums)
            out[a:b] = sums[hi[a:b] + 1] - sums[lo[a:b]]
    return out


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row and lists, of runs of windows with one anchor, of its hash and the first and last line."""
    for batch in batches:
        data, offsets = byte_view(batch.column(1))
        for lo, hi in pieces(offsets, PIECE):
            part, ends = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            at, best, _, start, text, _ = windows(part, ends)
            if len(at):
                line = _lines(part, ends, start, text)
                head = np.flatnonzero(np.r_[True, (best[1:] != best[:-1]) | (text[at[1:]] != text[at[:-1]])])
                last = at[np.r_[head[1:], len(at)] - 1] + WORDS - 1
                doc, lists = _grouped([best[head].view(np.int64), line[at[head]], line[last]], text[at[head]])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(lo + doc)), *lists], ["row", "h", "lo", "hi"])


def _open_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, c: how many runs that are not wholly in removed lines have an anchor."""
    for batch in batches:
        size = batch.column(0).value_lengths().to_numpy(zero_copy_only=False)
        h, lo, hi = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in range(3))
        u, c = np.unique(h[_removed_lines(lo, hi, size, batch.column(3)) <= hi - lo], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(c)], ["h", "c"])


def _periodic(at: np.ndarray, own: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Windows that overlap an equal one in their text. Those left out of at and own equal none of these."""
    out = np.zeros(len(at), bool)
    for d in range(1, min(WORDS, len(at))):
        same = np.flatnonzero((own[d:] == own[:-d]) & (at[d:] - at[:-d] < WORDS) & (text[at[d:]] == text[at[:-d]]))
        out[same] = out[same + d] = True
    return out


def _candidates(bits):
    """Streams (row, doc_id, text): row, doc_id and lists, of windows that may repeat, of place, hash, first and last line, and periodicity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_view(batch.column(2))
            for lo, hi in pieces(offsets, PIECE):
                part, ends = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                at, best, own, start, text, before = windows(part, ends)
                go = np.flatnonzero(_may_repeat(bits.value, best))
                if not len(go):
                    continue
                at, own = at[go], own[go]
                odd = _periodic(at, own, text)
                line = _lines(part, ends, start, text)
                place = (at - before[text[at]]).astype(np.int32)
                doc, lists = _grouped([place, own.view(np.int64), line[at], line[at + WORDS - 1], odd], text[at])
                rows = pa.array(lo + doc)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *lists], ["row", "doc_id", "at", "h", "lo", "hi", "odd"])

    return run


def _open_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each window that is not wholly in removed lines; whole: it touches none."""
    for batch in batches:
        size = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
        at, h, lo, hi, odd = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in range(2, 7))
        touched = _removed_lines(lo, hi, size, batch.column(7))
        keep = np.flatnonzero(touched <= hi - lo)
        of = pa.array(np.repeat(np.arange(len(size)), size)[keep])
        yield pa.RecordBatch.from_arrays([pa.array(h[keep]), batch.column(0).take(of), batch.column(1).take(of), pa.array(at[keep]), pa.array(touched[keep] == 0), pa.array(odd[keep])], ["h", "row", "doc_id", "at", "whole", "odd"])


def repeated_passages(slim: DataFrame, gone: DataFrame) -> DataFrame:
    """row, cuts (places of first words), origins (documents that keep the first): windows that repeat an earlier one.

    slim: row, doc_id, text; gone: row, gone (array of structs with place), the lines that are removed anyway. Earlier is
    by document id (null last), then row, then place. Only windows clear of removed lines count as first, so each word
    that is cut still stands elsewhere. A window that overlaps an equal one (a phrase over and over) is no repeat of its
    own text, but may be one of another.
    """
    kind = slim.schema["doc_id"].dataType.simpleString()
    lines = gone.select("row", F.transform("gone", lambda g: g["place"]).alias("gone"))
    runs = slim.select("row", "text").mapInArrow(_anchors, "row long, h array<long>, lo array<int>, hi array<int>")
    seen = runs.join(lines, "row", "left").select("h", "lo", "hi", "gone").mapInArrow(_open_anchors, "h long, c long")
    seen = materialize(seen.groupBy("h").agg(F.sum("c").alias("c")).where("c > 1").select("h"), "anchors")
    bits = slim.sparkSession.sparkContext.broadcast(_filter(seen))
    release(seen)
    found = slim.select("row", "doc_id", "text").mapInArrow(_candidates(bits), f"row long, doc_id {kind}, at array<int>, h array<long>, lo array<int>, hi array<int>, odd array<boolean>")
    flat = materialize(found.join(lines, "row", "left").mapInArrow(_open_windows, f"h long, row long, doc_id {kind}, at int, whole boolean, odd boolean"), "windows")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "at")
    # written first, so that adaptive execution may split the windows of a frequent hash in the join
    first = materialize(flat.groupBy("h").agg(F.min(F.when(F.col("whole"), key)).alias("first"), F.count("*").alias("c")).where("c > 1 AND first IS NOT NULL").select("h", "first"), "first")
    later = flat.join(first, "h").where((F.col("first") < key) & (~F.col("odd") | (F.col("first.row") != F.col("row"))))
    return later.groupBy("row").agg(F.collect_set("at").alias("cuts"), F.collect_set("first.doc_id").alias("origins"))  # at most a document's windows


def cut_text(text: str | None, cuts, removed) -> dict | None:
    """removed, n_cut, kept: the text without removed lines and without the words of the windows that start at cuts.

    Lines that lose all their words are removed as well; n_cut counts the words cut from the others.
    """
    if text is None:
        return None
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    start, end, _ = words(data, np.array([0, len(raw)]))
    steps = np.zeros(len(start) + 1, np.int64)
    cuts = np.array(cuts, np.int64)
    np.add.at(steps, cuts, 1)
    np.add.at(steps, cuts + WORDS, -1)
    marked = np.cumsum(steps[:-1]) > 0
    gone, kept, n_cut, a = set(removed), [], 0, 0
    for place, line in enumerate(raw.split(b"\n")):
        b = a + len(line)
        lo, hi = np.searchsorted(start, [a, b])
        m = marked[lo:hi]
        if place not in gone and m.any():
            if m.all():
                gone.add(place)
            else:
                n_cut += int(m.sum())
                # a cut reaches from a run's first word to the next word that stays, or back to the last one at the line's end
                edge = np.flatnonzero(np.diff(np.r_[False, m, False].astype(np.int8)))
                out, at = b"", a
                for x, y in zip((lo + edge[::2]).tolist(), (lo + edge[1::2]).tolist(), strict=True):
                    out += raw[at : start[x] if y < hi else end[x - 1]]
                    at = start[y] if y < hi else end[y - 1]
                line = out + raw[at:b]
        if place not in gone:
            kept.append(line)
        a = b + 1
    return {"removed": sorted(int(x) for x in gone), "n_cut": n_cut, "kept": b"\n".join(kept).decode()}
