"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star-shaped candidate edges.

1. One scan makes each text's set of word shingles, its 128-bit fingerprint and its signature: the hash space is cut
   into bins, a bin holds low bits of its smallest shingle hash, and an empty bin borrows from a bin chosen by a
   2-universal sequence of its own number. Equal sets are one class from here on, whatever their number.
2. Bands of bins are bucket keys. Every class of a bucket is paired with the bucket's smallest class only: a star, so
   candidates are linear in the classes. They are confirmed on full sets and joined into components.
3. A star can miss two members that are alike but unlike its centre. Buckets that still hold several components are
   therefore compared whole: in blocks of bounded size, only across components, and only pairs whose sizes and
   signatures allow the similarity (six standard deviations below it). A block confirms them on full sets itself and
   sends on a forest of links, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import byte_view, extended, groups, materialize, mix64, partitions, pieces, release, table, word_hashes
from tidemark.llm.graph import components

SHINGLE_WORDS = 5
#: Default similarity in percent: 100 * intersection >= PERCENT * union.
PERCENT = 80
#: The chance that a pair just at the threshold shares no band.
MISS = 1e-5
#: Bytes and number of texts handled at once, classes and shingles of a block, members confirmed by a task against one centre.
PIECE, TEXTS, BLOCK, BLOCK_HASHES, MEMBERS = 1 << 20, 2048, 512, 1_000_000, 512
#: Standard deviations below the threshold at which a signature rules a pair out (about one in a billion).
SLACK = 6.0


def bands_for(percent: int, miss: float = MISS) -> tuple[int, int]:
    """(bands, bins of a band): fewest bands of 6 (from 85 %), 5 (from 75 %) or 4 bins that lose at most `miss` of the pairs at the threshold."""
    rows = 6 if percent >= 85 else 5 if percent >= 75 else 4
    s = percent / 100
    return math.ceil(math.log(miss) / math.log(1 - s**rows)), rows


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash, text) of all word shingles, repeats included, in order of the texts, and the words of each text.

    A text of fewer words is one shingle, one without words has none.
    """
    _, _, doc, h = word_hashes(data, offsets)
    n = len(offsets) - 1
    counts = np.bincount(doc, minlength=n)
    first = np.cumsum(counts) - counts
    keys = mix64(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)
    keep = np.arange(len(h)) - first[doc] < np.maximum(counts - size + 1, 1)[doc]
    at = np.flatnonzero(keep)
    room = np.minimum(counts[doc[at]], size)
    s = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            has = room > k
            if has.all():
                s += h[at + k] * keys[k]
            else:
                s[has] += h[at[has] + k] * keys[k]
        s = mix64(s + room.astype(np.uint64))
    return s, doc[at], counts


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its word shingles."""
    s, doc, _ = shingles(data, offsets, size)
    edges = np.searchsorted(doc, np.arange(len(offsets)))
    out = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        x = np.sort(s[a:b])
        out.append(x[np.r_[True, x[1:] != x[:-1]]] if len(x) > 1 else x)
    return out


def distinct_sums(s: np.ndarray, doc: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashes of each text, [count, 2] a 128-bit sum over them that doesn't depend on their order)."""
    with np.errstate(over="ignore"):
        order = np.argsort(mix64(s + mix64(doc.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))))
        fresh = np.ones(len(s), bool)
        a, b = order[1:], order[:-1]
        fresh[a[(s[a] == s[b]) & (doc[a] == doc[b])]] = False
        s, doc = s[fresh], doc[fresh]
        edges = np.searchsorted(doc, np.arange(count + 1))
        sums = []
        for key in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9):
            total = np.r_[np.uint64(0), np.cumsum(mix64(s * np.uint64(key) + np.uint64(key >> 7)), dtype=np.uint64)]
            sums.append(total[edges[1:]] - total[edges[:-1]])
    return np.diff(edges), np.stack(sums, axis=1)


class Signer:
    """Signatures of one-permutation hashing over a number of bins."""

    def __init__(self, bins: int):
        self.bins = bins
        self.donors = np.zeros((bins, 0), np.int64)
        self.grow()

    def grow(self) -> None:
        """64 more tries of every bin: 2-universal draws from its number and the try."""
        tries = np.arange(self.donors.shape[1], self.donors.shape[1] + 64, dtype=np.uint64)
        with np.errstate(over="ignore"):
            draw = mix64(np.arange(self.bins, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + mix64(tries + np.uint64(77))[None, :])
        self.donors = np.hstack([self.donors, ((draw >> np.uint64(32)) % np.uint64(self.bins)).astype(np.int64)])

    def sign(self, hashes: np.ndarray, doc: np.ndarray, count: int) -> np.ndarray:
        """[count, bins]: 16 bits for each bin of each text, those of the smallest hash; 0 in texts without hashes.

        hashes and doc: the hashes of all texts and the text of each, in any order.
        """
        at = ((hashes >> np.uint64(32)) * np.uint64(self.bins) >> np.uint64(32)).astype(np.int64)
        least = np.full(count * self.bins, ~np.uint64(0), np.uint64)
        np.minimum.at(least, doc * self.bins + at, hashes)
        full = np.zeros((count, self.bins), bool)
        full[doc, at] = True
        out = (least & np.uint64(65535)).astype(np.uint16).reshape(count, self.bins)
        some = full.any(axis=1)
        out[~some] = 0
        row, empty = np.nonzero(~full & some[:, None])
        done = 0
        while len(row):
            if done == self.donors.shape[1]:
                self.grow()
            donor = self.donors[empty, done]
            hit = full[row, donor]
            out[row[hit], empty[hit]] = out[row[hit], donor[hit]]
            row, empty, done = row[~hit], empty[~hit], done + 1
        return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """[texts, bands] of longs: the band's number, then 48 bits, the same number of each of its bins."""
    bits = 48 // rows
    low = signature.reshape(len(signature), bands, rows).astype(np.int64) & ((1 << bits) - 1)
    return (low << (bits * np.arange(rows))).sum(axis=2) | (np.arange(bands, dtype=np.int64) << 48)


def band_bins(keys: np.ndarray, rows: int) -> np.ndarray:
    """The bins that band_keys() packed: (..., bands * rows)."""
    bits = 48 // rows
    out = (keys[..., None] >> (bits * np.arange(rows))) & ((1 << bits) - 1)
    return out.reshape(*keys.shape[:-1], -1).astype(np.uint16)


def signatures(units: DataFrame, ids: list[str], text_col: str, shape: tuple[int, int], size: int = SHINGLE_WORDS, min_words: int = 0) -> DataFrame:
    """ids..., _n, _fp, _bands, _row of every unit of at least min_words words. No shingles: _n 0 and the rest null."""
    bands, rows = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(bands * rows)
        for batch in batches:
            data, offsets = byte_view(batch.column(len(ids) + 1))
            for first, last in pieces(offsets, PIECE):
                for lo in range(first, last, TEXTS):
                    hi = min(lo + TEXTS, last)
                    s, doc, words = shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size)
                    n, sums = distinct_sums(s, doc, hi - lo)
                    keys = band_keys(signer.sign(s, doc, hi - lo), bands, rows)
                    none = n == 0
                    raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), hi - lo, [None, pa.py_buffer(np.ascontiguousarray(sums))]).cast(pa.binary())
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))
                    out = pa.RecordBatch.from_arrays([
                        *[batch.column(i).slice(lo, hi - lo) for i in range(len(ids) + 1)], pa.array(n.astype(np.int64)),
                        *[pc.if_else(pa.array(none), pa.scalar(None, x.type), x) if none.any() else x for x in (raw, lists)],
                    ], [*ids, "_row", "_n", "_fp", "_bands"])
                    yield out.filter(pa.array(words >= min_words)) if (words < min_words).any() else out

    slim = units.select(*ids, F.xxhash64(*ids, text_col).alias("_row"), F.col(text_col).alias("_text"))
    schema = extended(slim.drop("_text").schema, "_n long, _fp binary, _bands array<bigint>")
    return slim.mapInArrow(run, schema)


def full_sets(units: DataFrame, ids: list[str], text_col: str, rows: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """cid and set (sorted hashes as bytes) of the units that `rows` (row, cid) names, once from each task that has it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            cids = batch.column(0).to_pylist()
            new = [i for i, c in enumerate(cids) if not (c in seen or seen.add(c))]
            if len(new) < len(cids):
                batch = batch.take(pa.array(new, pa.int64()))
            data, offsets = byte_view(batch.column(1))
            for lo, hi in pieces(offsets, PIECE):
                sets = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([x.tobytes() for x in sets], pa.binary())], ["cid", "set"])

    slim = units.select(F.xxhash64(*ids, text_col).alias("row"), F.col(text_col).alias("text")).join(rows, "row")
    return slim.select("cid", "text").mapInArrow(run, "cid long, set binary")


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many hashes two sorted sets share."""
    if len(a) < len(b):
        a, b = b, a
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return int(np.count_nonzero(a[at] == b))


def _confirm(percent: int):
    """Streams (c, salt, role, a, set) sorted by c, salt, role: a centre's set, then its members'."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, have = None, np.zeros(0, np.uint64)
        for batch in batches:
            us, vs = [], []
            for c, role, a, raw in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), batch.column(4), strict=True):
                x = np.frombuffer(raw.as_buffer(), np.uint64)
                if role == 0:
                    centre, have = c, x
                    continue
                if c != centre or not len(have):
                    raise ValueError("a centre is missing")
                both = common(have, x)
                if 100 * both >= percent * (len(have) + len(x) - both):
                    us.append(a)
                    vs.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (u, v: classes) whose full sets are similar enough.

    A centre v with many members is repeated for salts of about MEMBERS of them, so no task gathers a hot one.
    """
    pairs = materialize(pairs, "pairs")
    loads = pairs.groupBy("v").agg(F.count("*").alias("n")).withColumn("salts", F.ceil(F.col("n") / MEMBERS).cast("int"))
    members = (
        pairs.join(loads, "v").withColumn("salt", F.pmod(F.xxhash64("u"), F.col("salts")).cast("int"))
        .join(sets, F.col("u") == F.col("cid")).select("v", "salt", F.lit(1).alias("role"), "u", "set")
    )
    centres = (
        loads.join(sets, F.col("v") == F.col("cid")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        .select("v", "salt", F.lit(0).alias("role"), F.col("v").alias("u"), "set")
    )
    dealt = centres.union(members).repartition(partitions(pairs), "v", "salt").sortWithinPartitions("v", "salt", "role")
    return dealt.mapInArrow(_confirm(percent), "u long, v long")


def _across(percent: int, bands: int, rows: int):
    """Links across components in a block (key, bi, bj, own, cid, comp, n, bands, set): confirmed on full sets, a forest.

    A pair is looked at only in the first band that it shares, and not once its components have met in the block.
    """
    least = bands * rows * percent / 100
    least -= SLACK * math.sqrt(bands * rows * percent / 100 * (1 - percent / 100))

    def links(key: int, bi: int, bj: int, side, comp, size, sig, sets) -> list[tuple[int, int]]:
        left = np.flatnonzero(side == bi)
        right = left if bi == bj else np.flatnonzero(side == bj)
        band, codes, out = key >> 48, band_bins(sig, rows), []
        for i in left:
            js = right[right > i] if bi == bj else right
            js = js[comp[js] != comp[i]]
            js = js[100 * np.minimum(size[js], size[i]) >= percent * np.maximum(size[js], size[i])]
            if len(js):
                js = js[~(sig[js, :band] == sig[i, :band]).any(axis=1)]
                alike = (codes[js] == codes[i]).sum(axis=1)
                js = js[alike >= least][np.argsort(-alike[alike >= least], kind="stable")]
            for j in js:
                if comp[i] != comp[j]:
                    both = common(sets[i], sets[j])
                    if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                        out.append((i, j))
                        comp[comp == comp[j]] = comp[i]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, 3):
            key, bi, bj = (g.column(i)[0].as_py() for i in range(3))
            side, cids, comp, size = (g.column(i).to_numpy() for i in range(3, 7))
            sig = np.array(g.column(7).to_pylist(), np.int64)
            found = links(key, bi, bj, side, comp.copy(), size, sig, [np.frombuffer(x.as_buffer(), np.uint64) for x in g.column(8)])
            if found:
                i, j = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(cids[i]), pa.array(cids[j])], ["u", "v"])

    return run


def residual_links(shared: DataFrame, classes: DataFrame, sets: DataFrame, parts: DataFrame, percent: int, shape: tuple[int, int]) -> DataFrame:
    """Links (u, v) between components that share a bucket, at most one fewer than a block's members for each block.

    shared: bk, cid, n; classes: cid, n, bands; sets: cid, set; parts: node, component.
    Blocks end where components do: one that fills half a block or more has blocks to itself, the others of a bucket share
    some. Only blocks of different components meet, so a giant component and its strays cost the giant's rows and the
    strays' times its blocks, never all pairs of the giant's blocks.
    """
    placed = materialize(shared.join(parts, F.col("cid") == F.col("node"), "left").select("bk", "cid", "n", F.coalesce("component", "cid").alias("comp")), "placed")
    held = placed.groupBy("bk", "comp").agg(F.count("*").alias("size"), F.sum("n").alias("load"))
    several = held.groupBy("bk").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("bk")
    fills = F.greatest(F.col("size") / BLOCK, F.col("load") / BLOCK_HASHES)
    held = materialize(held.join(several, "bk").withColumn("own", F.when(fills > 0.5, F.col("comp")).otherwise(F.lit(-1))), "held")
    kinds = materialize(held.groupBy("bk", "own").agg(F.sum("size").alias("size"), F.sum("load").alias("load")).select("bk", "own", F.ceil(fills).cast("int").alias("blocks")), "kinds")
    blocks = kinds.select("bk", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part")).select("bk", "own", F.xxhash64("own", "part").alias("b"))
    meet = blocks.select("bk", F.col("own").alias("oi"), F.col("b").alias("bi")).join(blocks.select("bk", F.col("own").alias("oj"), F.col("b").alias("bj")), "bk")
    meet = materialize(meet.where("bi <= bj AND (oi <> oj OR oi = -1)").select("bk", "bi", "bj"), "meet")
    rows = placed.drop("n").join(held.select("bk", "comp", "own"), ["bk", "comp"]).join(kinds, ["bk", "own"])
    rows = rows.select("bk", "cid", "comp", F.xxhash64("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")).alias("b"))
    sides = meet.select("bk", "bi", "bj", F.col("bi").alias("b")).union(meet.where("bi <> bj").select("bk", "bi", "bj", F.col("bj").alias("b")))
    rows = rows.join(sides, ["bk", "b"]).join(classes, "cid").join(sets, "cid")
    rows = rows.select("bk", "bi", "bj", F.col("b").alias("own"), "cid", "comp", "n", "bands", "set")
    dealt = rows.repartition(partitions(rows), "bk", "bi", "bj").sortWithinPartitions("bk", "bi", "bj")
    return dealt.mapInArrow(_across(percent, *shape), "u long, v long")


def near_duplicates(units: DataFrame, ids: list[str], text_col: str = "text", percent: int = PERCENT, size: int = SHINGLE_WORDS, shape: tuple[int, int] | None = None, min_words: int = 0) -> DataFrame:
    """ids..., _n (shingles), _class (of the component; null without shingles) of every unit, as a written table.

    Units whose shingle sets meet 100 * intersection >= percent * union are linked, and linked units share a class.
    Units without words link with nothing. Repeated rows and equal sets are one class. ids may be null; other columns
    of units are not read. An empty table gives no rows. shape: bands and bins of a band, else bands_for(percent). Units
    of fewer than min_words words are left out.
    """
    shape = shape or bands_for(percent)
    signed = materialize(signatures(units, ids, text_col, shape, size, min_words), "signed")
    classes = signed.where("_fp IS NOT NULL").groupBy(F.col("_fp").alias("fp")).agg(F.min("_row").alias("row"), F.first("_n").alias("n"), F.first("_bands").alias("bands"))
    # numbers are read back from the written table, so a lost task can't renumber them
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    keyed = classes.select(F.explode("bands").alias("bk"), "cid", "n")
    centres = keyed.groupBy("bk").agg(F.min(F.struct("cid", "n")).alias("c"), F.count("*").alias("members")).where("members > 1").select("bk", "c")
    shared = materialize(keyed.join(centres, "bk").select("bk", "cid", "n", F.col("c.cid").alias("c"), F.col("c.n").alias("cn")), "shared")
    near = (F.col("n") * 100 >= F.col("cn") * percent) & (F.col("cn") * 100 >= F.col("n") * percent)
    star = shared.where((F.col("cid") != F.col("c")) & near).select(F.col("cid").alias("u"), F.col("c").alias("v")).distinct()
    needed = classes.select("cid", "row").join(shared.select("cid").distinct(), "cid").select("row", "cid")
    sets = materialize(full_sets(units, ids, text_col, needed, size), "sets")
    links = materialize(confirmed(star, sets, percent), "links")
    parts = materialize(components(links), "parts")
    more = materialize(residual_links(shared.select("bk", "cid", "n"), classes.select("cid", "n", "bands"), sets, parts, percent, shape), "more")
    release(shared, sets)
    if not more.isEmpty():
        parts = materialize(components(links.union(more)), "parts")
    placed = classes.select("fp", "cid").join(parts, F.col("cid") == F.col("node"), "left").select("fp", F.coalesce("component", "cid").alias("_class"))
    out = materialize(signed.select(*ids, "_n", "_fp").join(placed, F.col("_fp") == F.col("fp"), "left").select(*ids, "_n", "_class"), "near")
    release(signed, classes, links, more)
    return out


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id of the linked documents), kept, one row per document.

    A null id takes part but never names a component unless it is alone (component_id is then null, and it is kept).
    """
    found = near_duplicates(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), ["doc_id"], "text", percent)
    # written first, so that adaptive execution may split a class of many documents in the join
    least = materialize(found.where("_class IS NOT NULL").groupBy("_class").agg(F.min("doc_id").alias("least")), "least")
    joined = found.join(least, "_class", "left")
    component = F.when(F.col("_class").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return joined.select("doc_id", F.col("_n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"), percent=85)


OP6_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT k, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM texts
), sizes AS (
  SELECT k, count(*) AS n FROM shingles GROUP BY k
), common AS (
  SELECT a.k AS u, b.k AS v, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.k <> b.k GROUP BY a.k, b.k
), links AS (
  SELECT u, v FROM common JOIN sizes x ON x.k = u JOIN sizes y ON y.k = v WHERE 100 * c >= 85 * (x.n + y.n - c)
), reached AS (
  SELECT k AS u, k AS v FROM texts UNION SELECT reached.u, links.v FROM reached JOIN links ON reached.v = links.u
), least AS (
  SELECT u AS k, min(doc_id) AS component_id FROM reached JOIN texts ON texts.k = reached.v GROUP BY u
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM texts JOIN least USING (k) LEFT JOIN sizes USING (k)
"""
