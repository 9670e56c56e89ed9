"""Suffix-array dedup: every byte covered by a string of 100 bytes that also starts earlier is removed.

1. Anchors: each 100-byte window has a content-defined anchor, so equal windows meet under one hash. Hashes of the 69
   bytes around it that are seen twice or more set bits in a filter of fixed size; a false bit only costs work.
2. Shards: runs of windows whose anchor may repeat go, with their bytes, to the shard of that hash. A shard builds the
   suffix array of its distinct pieces by Larsson-Sadakane refinement, and Kasai's recursion gives its windows' prefixes;
   suffixes that share 100 bytes are one group, and all but its earliest member are repeats.
3. Merging: a hash with more than its part of the runs that may repeat is spread over many shards. Each sends on its
   survivors as it has them, in the order of its suffix array and cut into buckets by a hash of their 100 bytes. A bucket's
   runs, one from each shard, are merged by binary search of one in the other; all but the earliest of a prefix are lost.
4. Removal: windows that may repeat, less the survivors that the merge doesn't lose, are the repeats; the bytes they cover
   are cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.anchors import WINDOW, runs
from tidemark.llm.common import byte_view, materialize, mix64, partitions, pieces, release, table

#: Bits of the filter (16 MB), whatever the corpus; bytes of a shard; bytes of text handled at once.
FILTER_BITS, SHARD, PIECE = 27, 1 << 19, 1 << 18
#: A hash with more than this part of all runs that may repeat is spread over shards; so at most its inverse are.
HOT = 1e-4
#: Windows of a bucket of the merge, about, and of a run cut into buckets at once.
BUCKET, CHUNK = 1 << 16, 1 << 15
#: An anchor's hash with fewer runs than these can't fill more than a shard.
FEW = 2 * SHARD // (2 * WINDOW)


def _refine(symbols: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The suffix array of texts laid end to end, by doubling; only groups not yet sorted are sorted again.

    symbols: byte + 1; end: where each position's text ends. A suffix that is a prefix of another sorts before it, and
    equal suffixes sort by place, as if each text closed with its own smallest symbol.
    """
    n = len(symbols)
    padded = np.r_[symbols.astype(np.int64), np.zeros(7, np.int64)]
    room = (end - np.arange(n)).astype(np.int32)
    key = np.zeros(n, np.int64)
    for j in range(7):
        key <<= 9
        key |= np.where(room > j, padded[j : j + n], 0)
    sa = np.argsort(key).astype(np.int32)
    key = key[sa]
    head = np.r_[True, key[1:] != key[:-1], True]
    rank = np.empty(n, np.int32)
    rank[sa] = np.maximum.accumulate(np.where(head[:-1], np.arange(n, dtype=np.int32), 0))
    at = np.flatnonzero(~(head[:-1] & head[1:])).astype(np.int32)
    depth = 7
    longest = int(room.max(initial=0))
    while depth < longest and len(at):
        pos = sa[at]
        second = np.where(depth < room[pos], rank[np.minimum(pos + np.int32(depth), n - 1)] + 1, 0)
        pair = rank[pos].astype(np.int64) << 32 | second
        order = np.argsort(pair)
        pos, pair = pos[order], pair[order]
        sa[at] = pos
        head = np.r_[True, pair[1:] != pair[:-1], True]
        rank[pos] = at[np.maximum.accumulate(np.where(head[:-1], np.arange(len(at)), 0))]
        at = at[~(head[:-1] & head[1:])]
        depth *= 2
    if len(at):
        pos = sa[at]
        sa[at] = pos[np.argsort(rank[pos].astype(np.int64) << 32 | pos)]
    return sa


#: The lowest bit of each byte of a 64-bit word.
_BYTE = np.uint64(1) << (np.uint64(8) * np.arange(8, dtype=np.uint64))


def _kasai(data: np.ndarray, sa: np.ndarray, start: np.ndarray, size: np.ndarray, end: np.ndarray) -> np.ndarray:
    """common[i]: bytes, WINDOW at most, that the window at i shares with its predecessor in sa; 0 where no window starts.

    Kasai's recursion, all texts in step and eight bytes at a time. A count cut at WINDOW still falls by one at most from
    a window to the next, and windows that share WINDOW bytes have no shorter suffix between them.
    """
    n = len(data)
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(np.r_[data, np.zeros(7, np.uint8)], 8)).view("<u8").ravel()
    common = np.zeros(n, np.int32)
    h = np.zeros(len(start), np.int32)
    windows = np.maximum(size - WINDOW + 1, 0)
    live = np.flatnonzero(windows)
    for t in range(int(windows.max(initial=0))):
        live = live[windows[live] > t]
        i = (start[live] + t).astype(np.int32)
        j = before[i]
        stop = np.where(j >= 0, np.minimum(end[np.maximum(j, 0)] - j, WINDOW), 0).astype(np.int32)
        have = np.minimum(np.maximum(h[live] - 1, 0), stop)
        on = np.flatnonzero(have < stop)
        while len(on):
            differ = eight[i[on] + have[on]] ^ eight[j[on] + have[on]]
            equal = np.searchsorted(_BYTE, differ & (~differ + np.uint64(1)), side="right") - 1
            equal[differ == 0] = 8
            have[on] = np.minimum(have[on] + equal, stop[on])
            on = on[(equal == 8) & (have[on] < stop[on])]
        h[live] = have
        common[i] = have
    return common


def survivors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of distinct texts in order of place, laid end to end: their bytes; where each starts; the text of each byte; and
    which windows no earlier text holds, in the order of the suffix array, that of their 100 bytes.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    start = np.cumsum(size) - size
    text = np.repeat(np.arange(len(texts)), size)
    end = (start + size)[text]
    sa = _refine(data.astype(np.int16) + 1, end)
    common = _kasai(data, sa, start, size, end)
    pos = sa[(end - np.arange(len(data)) >= WINDOW)[sa]]
    first = np.minimum.reduceat(pos, np.flatnonzero(common[pos] < WINDOW)) if len(pos) else pos
    return data, start, text, first


def _hashes(docs: DataFrame) -> DataFrame:
    """h, c: counts of the long hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_view(batch.column(0))
            for lo, hi in pieces(offsets, PIECE):
                u, c = np.unique(runs(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(c)], ["h", "c"])

    return docs.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _loads(docs: DataFrame, words) -> DataFrame:
    """h, c: how many runs that may repeat each anchor's hash has, all of them counted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_view(batch.column(0))
            for lo, hi in pieces(offsets, PIECE):
                *_, long, _, g = runs(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                u, c = np.unique(g[_may_repeat(words.value, long)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(c)], ["h", "c"])

    return docs.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _filter(repeated: DataFrame) -> np.ndarray:
    """The filter as words of 64 bits; the driver gets one row for each word that is set, a fixed number at most."""
    bit = F.shiftrightunsigned("h", 64 - FILTER_BITS)
    words = repeated.select(F.shiftright(bit, 6).alias("w"), F.pow(F.lit(2.0), bit % 32).cast("long").alias("b"), (bit % 64 >= 32).alias("high"))
    rows = words.groupBy("w").agg(F.bit_or(F.when(~F.col("high"), F.col("b"))).alias("lo"), F.bit_or(F.when(F.col("high"), F.col("b"))).alias("hi")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    lo, hi = (np.nan_to_num(rows.column(c).fill_null(0).to_numpy()).astype(np.uint64) for c in ("lo", "hi"))
    out[rows.column("w").to_numpy()] = lo | (hi << np.uint64(32))
    return out


def _may_repeat(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    bit = h.view(np.uint64) >> np.uint64(64 - FILTER_BITS)
    return (words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def _pieces(docs: DataFrame, words, hot: dict[int, int]) -> DataFrame:
    """h, salt, doc, th, at, bytes of the runs that may repeat; equal ones of a batch once, by their first place."""
    hot_h = np.array(sorted(hot), np.int64)
    hot_n = np.array([hot[x] for x in sorted(hot)], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_view(batch.column(2))
            doc, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            order = np.lexsort((th, doc))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            for lo, hi in pieces(offsets, PIECE):
                text, start, count, long, anchor, h = runs(part := data[offsets[lo] : offsets[hi]], own := offsets[lo : hi + 1] - offsets[lo])
                go = np.flatnonzero(_may_repeat(words.value, long))
                # parts of one anchor that both may repeat are one piece
                joint = np.flatnonzero(np.r_[False, (anchor[go][1:] == anchor[go][:-1]) & (start[go][1:] == (start + count)[go][:-1])])
                count[go[joint - 1]] += count[go[joint]]
                go = np.delete(go, joint)
                go = go[np.argsort(rank[lo + text[go]], kind="stable")]
                raw = part.tobytes()
                cut = [raw[s : s + c + WINDOW - 1] for s, c in zip(start[go].tolist(), count[go].tolist(), strict=True)]
                seen: set[bytes] = set()
                fresh = np.array([not (x in seen or seen.add(x)) for x in cut], bool)
                go, cut = go[fresh], [x for x, f in zip(cut, fresh, strict=True) if f]
                salt = np.zeros(len(go), np.int32)
                if len(hot_h):
                    k = np.minimum(np.searchsorted(hot_h, h[go]), len(hot_h) - 1)
                    for i in np.flatnonzero(hot_h[k] == h[go]):
                        salt[i] = 1 + int.from_bytes(hashlib.blake2b(cut[i], digest_size=4).digest(), "big") % int(hot_n[k[i]])
                yield pa.RecordBatch.from_arrays([pa.array(h[go]), pa.array(salt), pa.array(doc[lo + text[go]]), pa.array(th[lo + text[go]]), pa.array(start[go] - own[text[go]]), pa.array(cut, pa.binary())], ["h", "salt", "doc", "th", "at", "bytes"])

    return docs.mapInArrow(run, "h long, salt int, doc long, th int, at long, bytes binary")


#: What shards emit: survivors (flags of windows from at on, never 0), and runs of those that are to be merged.
_SHARD_SCHEMA = "doc long, th int, at long, alive long, bucket long, prefixes binary, docs array<bigint>, ths array<int>, ats array<bigint>"
_SHARD_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]
_SHARD_NAMES = ["doc", "th", "at", "alive", "bucket", "prefixes", "docs", "ths", "ats"]


def _batch(some: dict[str, pa.Array], n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([some[c].cast(t) if c in some else pa.nulls(n, t) for c, t in zip(_SHARD_NAMES, _SHARD_TYPES, strict=True)], _SHARD_NAMES)


def bucketed(data: np.ndarray, pos: np.ndarray, places: tuple[np.ndarray, ...], buckets: int) -> Iterator[pa.RecordBatch]:
    """The windows at pos, which are in the order of their bytes, with their places: a run in that order for each bucket."""
    for lo in range(0, len(pos), CHUNK):
        own = pos[lo : lo + CHUNK]
        prefix = np.zeros((len(own), -(-WINDOW // 8) * 8), np.uint8)
        prefix[:, :WINDOW] = data[own[:, None] + np.arange(WINDOW)]
        key = np.zeros(len(own), np.uint64)
        for word in prefix.view(np.uint64).T:
            key = mix64(key ^ word)
        bucket = (key % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]).astype(np.int32)
        raw = pa.py_buffer(np.ascontiguousarray(prefix[order, :WINDOW]))
        lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x[lo : lo + CHUNK][order])) for x in places]
        prefixes = pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(cut * np.int32(WINDOW)), raw])
        yield _batch({"bucket": pa.array(bucket[cut[:-1]]), "prefixes": prefixes} | dict(zip(("docs", "ths", "ats"), lists, strict=True)), len(cut) - 1)


def _shards(buckets: int):
    """Streams the pieces sorted by (h, salt, doc, th, at) to _SHARD_SCHEMA."""
    def solve(held: list[tuple], split: list[bool]) -> Iterator[pa.RecordBatch]:
        # the parts of a hot hash that meet here hold equal windows, so texts must stand in order of place
        order = sorted(range(len(held)), key=lambda i: held[i][:3])
        held, merge = [held[i] for i in order], np.array([split[i] for i in order], bool)
        doc, th, at = (np.array([x[k] for x in held], t) for k, t in enumerate((np.int64, np.int32, np.int64)))
        data, start, text, first = survivors([x[3] for x in held])
        later = merge[text[first]]
        flags = np.zeros(len(held), np.uint64)  # the first window in the lowest bit; windows lie below 64
        np.add.at(flags, text[first], np.uint64(1) << (first - start[text[first]]).astype(np.uint64))
        some = np.flatnonzero(flags)
        yield _batch({"doc": pa.array(doc[some]), "th": pa.array(th[some]), "at": pa.array(at[some]), "alive": pa.array(flags[some].view(np.int64))}, len(some))
        pos = first[later]
        t = text[pos]
        yield from bucketed(data, pos, (doc[t], th[t], at[t] + pos - start[t]), buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, split, size = [], [], 0
        group, seen, mark = None, set(), False
        for batch in batches:
            for h, salt, doc, th, at, raw in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if (h, salt) != group:
                    if size >= SHARD:
                        yield from solve(held, split)
                        held, split, size = [], [], 0
                    group, seen, mark = (h, salt), set(), salt > 0
                if raw in seen:
                    continue
                if size >= 2 * SHARD:
                    # one group fills more than a shard: its parts are merged like those of a hot hash
                    own = len(seen)
                    split[len(split) - own :] = [True] * own
                    yield from solve(held, split)
                    held, split, size, seen, mark = [], [], 0, set(), True
                seen.add(raw)
                held.append((doc, th, at, raw))
                split.append(mark)
                size += len(raw)
        if held:
            yield from solve(held, split)

    return run


#: A run to be merged: its prefixes, ascending, and the place of each.
Run = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def merged(a: Run, b: Run) -> tuple[Run, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Both runs in one, each prefix once, by its earliest place, and the later places that it loses.

    The prefixes of the shorter run are searched in the longer. A place that is in both is kept once and not lost.
    """
    if len(a[0]) < len(b[0]):
        a, b = b, a
    at = np.searchsorted(a[0], b[0])
    hit = a[0][np.minimum(at, len(a[0]) - 1)] == b[0]
    i, j = at[hit], np.flatnonzero(hit)
    earlier, same = np.zeros(len(i), bool), np.ones(len(i), bool)
    for x, y in zip(a[:0:-1], b[:0:-1], strict=True):
        earlier = (y[j] < x[i]) | ((y[j] == x[i]) & earlier)
        same &= y[j] == x[i]
    lost = tuple(np.where(earlier, x[i], y[j])[~same] for x, y in zip(a[1:], b[1:], strict=True))
    for x, y in zip(a[1:], b[1:], strict=True):
        x[i[earlier]] = y[j[earlier]]
    return tuple(np.insert(x, at[~hit], y[~hit]) for x, y in zip(a, b, strict=True)), lost


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams runs (bucket, prefixes, docs, ths, ats) sorted by bucket; emits all places of a prefix but the earliest.

    Runs wait on a stack and are merged with those of their size, so a bucket's windows move as often as its runs' number
    has digits, and what is held is its distinct prefixes, not all copies.
    """
    def fold(stack: list[Run], most: int) -> Iterator[pa.RecordBatch]:
        while len(stack) > 1 and len(stack[-2][0]) <= most * len(stack[-1][0]):
            run, (doc, th, at) = merged(stack.pop(), stack.pop())
            stack.append(run)
            if len(doc):
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(th), pa.array(at), pa.array(np.zeros(len(doc), np.int64))], ["doc", "th", "at", "alive"])

    stack, bucket = [], None
    for batch in batches:
        for i, b in enumerate(batch.column(0).to_pylist()):
            if b != bucket:
                yield from fold(stack, 1 << 60)
                stack, bucket = [], b
            prefix = np.frombuffer(batch.column(1)[i].as_buffer(), f"S{WINDOW}")
            stack.append((prefix, *(batch.column(k)[i].values.to_numpy(zero_copy_only=False).copy() for k in (2, 3, 4))))
            yield from fold(stack, 2)
    yield from fold(stack, 1 << 60)


def alive_windows(docs: DataFrame, words, hot: dict[int, int], buckets: int) -> DataFrame:
    """doc, th, at, alive: of the windows that may repeat, those that start nowhere earlier.

    alive flags windows from at on; a row where it is 0 takes back the window at this place.
    """
    cut = _pieces(docs, words, hot)
    dealt = cut.repartition(partitions(cut), "h", "salt").sortWithinPartitions("h", "salt", "doc", "th", "at")
    found = materialize(dealt.mapInArrow(_shards(buckets), _SHARD_SCHEMA), "alive")
    parts = found.where("bucket IS NOT NULL").select("bucket", "prefixes", "docs", "ths", "ats")
    runs_of = parts.repartition(partitions(parts), "bucket").sortWithinPartitions("bucket")
    return found.where("bucket IS NULL").select("doc", "th", "at", "alive").union(runs_of.mapInArrow(_merge, "doc long, th int, at long, alive long"))


def _cut(words):
    """Streams (id, doc, th, text, places, flags): counts, digest and text of what is left."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_view(batch.column(1))
            out = []
            for lo, hi in pieces(offsets, PIECE):
                part, own = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                _, start, count, long, *_ = runs(part, own)
                go = np.flatnonzero(_may_repeat(words.value, long))
                steps = np.zeros(len(part) + 1, np.int64)
                np.add.at(steps, start[go], 1)
                np.add.at(steps, start[go] + count[go], -1)
                repeat = np.cumsum(steps[:-1]) > 0
                for i in range(lo, hi):
                    places, flags = batch.column(2)[i].values, batch.column(3)[i].values
                    if places is None or not len(places):
                        continue
                    places, flags = places.to_numpy(), flags.to_numpy()
                    bits = (flags.view(np.uint64)[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1) == 1
                    r, c = np.nonzero(bits)
                    repeat[own[i - lo] + places[r] + c] = False
                    repeat[own[i - lo] + places[flags == 0]] = True
                at = np.flatnonzero(repeat)
                steps[:] = 0
                np.add.at(steps, at, 1)
                np.add.at(steps, at + WINDOW, -1)
                gone = np.cumsum(steps[:-1]) > 0
                for i in range(hi - lo):
                    a, b = own[i], own[i + 1]
                    g = gone[a:b]
                    spans = int(np.count_nonzero(g & ~np.r_[False, g[:-1]])) if b > a else 0
                    out.append((int(b - a), int(g.sum()), spans, part[a:b][~g].tobytes()))
            n, removed, spans, kept = zip(*out, strict=True) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes, as a cut may split a character): one row per document.

    A byte is removed if a string of 100 bytes that covers it also starts earlier: in a smaller id, or before in the same
    text. Null ids sort last, different texts of one id by a hash; rows that repeat id and text are one document and get
    the same result. A null text is empty. Other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    order = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))
    slim = docs.select(F.col(id_col).alias("id"), order.alias("doc"), F.hash(text_col).alias("th"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    repeated = materialize(_hashes(slim).where("c > 1").select("h"), "anchors")
    words = spark.sparkContext.broadcast(_filter(repeated))
    release(repeated)
    loads = materialize(_loads(slim, words), "loads")
    share = max(loads.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0] * HOT, 1000.0)
    hot = {r["h"]: int(-(-r["c"] // share)) for r in loads.where(F.col("c") > share).collect()}  # at most 1 / HOT rows
    # what may be merged: at most 64 windows of each run of a hash that is hot or may fill more than a shard
    many = loads.where(F.col("c") > min(share, FEW)).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0] * 64
    release(loads)
    alive = alive_windows(slim.select("doc", "th", "text"), words, hot, max(-(-many // BUCKET), partitions(slim)))
    lists = alive.groupBy("doc", "th").agg(F.collect_list("at").alias("places"), F.collect_list("alive").alias("flags"))  # at most a document's windows
    joined = slim.join(lists, ["doc", "th"], "left").select("id", "text", "places", "flags")
    kind = docs.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(_cut(words), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).drop("kept")


OP7_SQL = r"""
WITH texts AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents
), windows AS (
  SELECT doc_id, p, array_slice(b, p, p + 99) AS w FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 98)) AS p FROM texts)
), repeats AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS nth FROM windows) WHERE nth > 1
), joined AS (
  SELECT doc_id, p, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100, true) AS opens FROM repeats
), numbered AS (
  SELECT doc_id, p, sum(opens::INTEGER) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM joined
), spans AS (
  SELECT doc_id, min(p) AS a, max(p) + 99 AS z FROM numbered GROUP BY doc_id, span
), gaps AS (
  SELECT doc_id, coalesce(lag(z) OVER o, 0) + 1 AS a, a - 1 AS z FROM spans WINDOW o AS (PARTITION BY doc_id ORDER BY a)
  UNION ALL SELECT t.doc_id, coalesce(max(z), 0) + 1, any_value(octet_length(b)) FROM texts t LEFT JOIN spans s ON s.doc_id = t.doc_id GROUP BY t.doc_id
), kept AS (
  SELECT doc_id, unhex(string_agg(hex(array_slice(b, a, z)), '' ORDER BY a)) AS bytes FROM gaps JOIN texts USING (doc_id) WHERE a <= z GROUP BY doc_id
), cut AS (
  SELECT doc_id, sum(z - a + 1) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id
)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(coalesce(bytes, ''::BLOB)) AS kept_sha256
FROM texts LEFT JOIN cut USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
