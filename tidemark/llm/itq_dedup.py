"""Embedding near-dedup by iterative quantisation and multi-index Hamming tables.

Codes: vectors are projected on principal directions and turned by learnt rotations that bring them near the corners of
the binary cube (ITQ), once for each of several random starts. Tables: each code is cut into chunks of about log2(rows)
bits, and a (label, rotation, chunk, value) is a bucket of an exact-match Hamming table. Rotations are added until made
pairs just at the threshold, around vectors of the sample, meet in a bucket with the recall asked for; vectors are
centred only where that costs no recall. Filter: members of a bucket that have no partner within a Hamming distance
that such pairs keep drop out of it, on codes alone. Rerank: pairs that are left are compared by cosine of the original
vectors in double precision, so no wrong link can come out.
Equal vectors of a label are one class with a count, so a hot vector costs one row. A bucket is cut into blocks and its
pairs of blocks are dealt to tasks; a pair is told only by the first bucket that holds both, so counts add up without
a list of pairs, and each block sends counts and a spanning star, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import groups, materialize, mix64, partitions, release, table
from tidemark.llm.graph import components

COSINE = 0.93
#: Bits of a code (at most the dimension), and rotations to begin with and at most.
BITS, ROTATIONS, MOST_ROTATIONS = 64, 4, 48
#: Share of the pairs just at the threshold that must meet, measured on MADE pairs.
RECALL, MADE = 0.993, 4096
#: Vectors that the rotations are learnt from, at most (those whose id hashes lowest), and rounds of learning.
SAMPLE, ROUNDS = 8192, 30
#: Vectors are centred if 99 of 100 lie at least this far from the mean (unit vectors): nearer ones lose neighbours by it.
RADIUS = 0.9
#: Members of a block; buckets up to SMALL members are compared together. Low bits of a key that hold its table.
BLOCK, SMALL, TABLE_BITS = 512, 24, 10
_SEED = 7


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id, label, dim, vec (bytes of doubles) of the rows that can link: label and vector not null, finite, not zero."""
    x = F.transform(vector_col, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), x.alias("x")).where(F.col("label").isNotNull() & F.col("x").isNotNull() & fine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(2)
            raw = [(np.asarray(v.values) + 0.0).tobytes() for v in col]  # + 0.0: one zero
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(r) // 8 for r in raw], pa.int32()), pa.array(raw, pa.binary())], ["id", "label", "dim", "vec"])

    kinds = {n: t for n, t in rows.dtypes}
    return rows.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, dim int, vec binary")


class Itq:
    """Mean, principal directions, rotations, width of chunks and the distance that filters; keys() gives table keys and codes.

    sample: vectors, not zero; rows: how many are to be indexed. recall: share of the made pairs that met.
    """

    def __init__(self, sample: np.ndarray, rows: int, cosine: float = COSINE, bits: int = BITS, rounds: int = ROUNDS):
        self.rng = np.random.default_rng(_SEED)
        x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        mean = x.mean(axis=0)
        far = np.quantile(np.linalg.norm(x - mean, axis=1), 0.01) >= RADIUS
        self.mean = mean if far else np.zeros_like(mean)
        values, directions = np.linalg.eigh((x - self.mean).T @ (x - self.mean))
        self.bits = min(bits, x.shape[1])
        self.directions = directions[:, np.argsort(-values)[: self.bits]]
        v = (x - self.mean) @ self.directions
        # pairs at the threshold: from a vector of the sample towards another one
        i, j = self.rng.integers(0, len(x), (2, MADE))
        z = x[j] - (x[j] * x[i]).sum(axis=1, keepdims=True) * x[i]
        z += 1e-3 * self.rng.normal(size=z.shape) / np.sqrt(z.shape[1])
        z -= (z * x[i]).sum(axis=1, keepdims=True) * x[i]
        size = np.linalg.norm(z, axis=1, keepdims=True)
        a, b = x[i], cosine * x[i] + np.sqrt(1 - cosine**2) * z / np.where(size > 0, size, 1)
        width = int(np.clip(np.ceil(np.log2(max(rows, 1) / 4)), 8, 30)) if rows > 4 else 8
        while True:
            self.chunks, self.rotations, met = max(1, self.bits // width), [], np.zeros(MADE, bool)
            while len(self.rotations) < MOST_ROTATIONS and (len(self.rotations) < ROTATIONS or met.mean() < RECALL):
                self.rotations.append(self._rotation(v, rounds))
                met |= (self._chunks(a, -1) == self._chunks(b, -1)).any(axis=1)
            self.recall = float(met.mean())
            if self.recall >= RECALL or width <= 8:
                break
            width -= 2
        self.distance = int(np.bitwise_count(self.codes(a) ^ self.codes(b)).max(initial=0)) + 2

    def _rotation(self, v: np.ndarray, rounds: int) -> np.ndarray:
        r = np.linalg.qr(self.rng.normal(size=(self.bits, self.bits)))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        return r

    def _signs(self, x: np.ndarray, rotation: int) -> np.ndarray:
        dim = len(self.mean)
        x = x[:, :dim] if x.shape[1] >= dim else np.pad(x, ((0, 0), (0, dim - x.shape[1])))
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        v = (x / np.where(norm > 0, norm, 1) - self.mean) @ self.directions
        return (v @ self.rotations[rotation] >= 0).astype(np.int64)

    def _chunks(self, x: np.ndarray, rotation: int) -> np.ndarray:
        """[rows, chunks]: the chunks' bits of one rotation."""
        bits = self._signs(x, rotation)
        return np.stack([(bits[:, p] << np.arange(len(p))).sum(axis=1) for p in np.array_split(np.arange(self.bits), self.chunks)], axis=1)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """The whole code of the first rotation."""
        return (self._signs(x, 0) << np.arange(self.bits)).sum(axis=1)

    def keys(self, x: np.ndarray) -> np.ndarray:
        """[rows, rotations * chunks]: the chunks' bits."""
        return np.hstack([self._chunks(x, i) for i in range(len(self.rotations))])


def _unpack(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), float).reshape(-1, dim)


def _tables(itq: Itq):
    """Streams (cid, dim, vec, lh): cid, code, keys; a key has its table in the low bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                dims = part.column(1).to_numpy()
                keys = np.zeros((part.num_rows, len(itq.rotations) * itq.chunks), np.int64)
                codes = np.zeros(part.num_rows, np.int64)
                for dim in np.unique(dims):
                    at = np.flatnonzero(dims == dim)
                    x = _unpack(part.column(2).take(pa.array(at)), int(dim))
                    keys[at], codes[at] = itq.keys(x), itq.codes(x)
                place = np.arange(keys.shape[1], dtype=np.int64)
                with np.errstate(over="ignore"):
                    own = mix64(part.column(3).to_numpy().view(np.uint64) + dims.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                    keys = mix64((keys + (place << 48)[None, :]).view(np.uint64) + own[:, None]).view(np.int64)
                keys = (keys >> TABLE_BITS << TABLE_BITS) | place[None, :]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(codes), pa.array(list(keys), pa.list_(pa.int64()))], ["cid", "code", "keys"])

    return run


def _dealt(members: DataFrame) -> DataFrame:
    """key, bi, bj, own and the other columns of members (key, cid...): each member once for each pair of blocks of its bucket.

    Buckets of one member are left out.
    """
    full = members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    placed = members.join(full, "key").withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    more = [c for c in members.columns if c != "key"]
    return placed.select("key", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "own", *more)


def _grouped(small, large):
    """Streams groups of (key, bi, bj, ...): buckets up to SMALL go to small() many at once, pairs of blocks to large()."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, rows = [], 0
        for g in groups(batches, 3):
            if g.column(1)[0].as_py() == g.column(2)[0].as_py() and g.num_rows <= SMALL:
                if g.num_rows > 1:
                    waiting.append(g)
                    rows += g.num_rows
                if rows >= 20_000:
                    yield from small(waiting)
                    waiting, rows = [], 0
            else:
                yield from large(g)
        if waiting:
            yield from small(waiting)

    return run


def _steps(tables: list[pa.Table]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (i, j) of one bucket, at distance 1, 2, ... in the concatenated rows."""
    group = np.repeat(np.arange(len(tables)), [x.num_rows for x in tables])
    for step in range(1, SMALL):
        i = np.flatnonzero(group[:-step] == group[step:]) if step < len(group) else np.zeros(0, int)
        if not len(i):
            return
        yield i, i + step


def _near_codes(distance: int):
    """Streams (key, bi, bj, own, cid, code) in groups; gives (key, cid) of members that have a partner within the distance."""
    def small(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        t = pa.concat_tables(tables)
        code = t.column(5).to_numpy()
        near = np.zeros(len(code), bool)
        for i, j in _steps(tables):
            good = np.bitwise_count(code[i] ^ code[j]) <= distance
            near[i[good]] = near[j[good]] = True
        at = np.flatnonzero(near)
        yield pa.RecordBatch.from_arrays([pa.array(t.column(0).to_numpy()[at]), pa.array(t.column(4).to_numpy()[at])], ["key", "cid"])

    def large(g: pa.Table) -> Iterator[pa.RecordBatch]:
        own, cid, code = (g.column(i).to_numpy() for i in (3, 4, 5))
        apart = (own[:, None] != own[None, :]) if g.column(1)[0].as_py() != g.column(2)[0].as_py() else ~np.eye(len(own), dtype=bool)
        at = np.flatnonzero(((np.bitwise_count(code[:, None] ^ code[None, :]) <= distance) & apart).any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(g.column(0).to_numpy()[at]), pa.array(cid[at])], ["key", "cid"])

    return _grouped(small, large)


def _links(cosine: float):
    """Streams (key, bi, bj, own, cid, mult, dim, lh, vec, keys) in groups; gives (u, links, v): counts and a star of links."""
    low = (1 << TABLE_BITS) - 1

    def batch_of(us: np.ndarray, links: np.ndarray, vs: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(us), pa.array(links), pa.array(vs)], ["u", "links", "v"])

    def read(t: pa.Table) -> tuple[np.ndarray, ...]:
        """cid, mult, label and dimension as one column, vectors (padded with zeros), norms, keys."""
        cid, mult, dim, lh = (t.column(i).to_numpy() for i in (4, 5, 6, 7))
        x = np.zeros((len(dim), dim.max()))
        for d in np.unique(dim):
            own = np.flatnonzero(dim == d)
            x[own, :d] = _unpack(t.column(8).take(pa.array(own)), int(d))
        keys = np.stack([k.values.to_numpy() for k in t.column(9)])
        return cid, mult, np.rec.fromarrays([dim, lh]), x, np.sqrt((x * x).sum(axis=1)), keys

    def small(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        t = pa.concat_tables(tables)
        place = t.column(0).to_numpy() & low
        cid, mult, kind, x, norm, keys = read(t)
        for i, j in _steps(tables):
            good = kind[i] == kind[j]
            i, j = i[good], j[good]
            good = (x[i] * x[j]).sum(axis=1) >= cosine * norm[i] * norm[j]
            i, j = i[good], j[good]
            first = ~((keys[i] == keys[j]) & (np.arange(keys.shape[1])[None, :] < place[i][:, None])).any(axis=1)
            i, j = i[first], j[first]
            if len(i):
                yield batch_of(np.r_[cid[i], cid[j]], np.r_[mult[j], mult[i]], np.r_[cid[j], cid[j]])

    def large(g: pa.Table) -> Iterator[pa.RecordBatch]:
        key, bi, bj = (g.column(i)[0].as_py() for i in range(3))
        own = g.column(3).to_numpy()
        cid, mult, kind, x, norm, keys = read(g)
        linked = (own[:, None] != own[None, :]) if bi != bj else ~np.eye(len(own), dtype=bool)
        linked &= kind[:, None] == kind[None, :]
        for t in range(key & low):  # pairs that an earlier table holds are told there
            linked &= keys[:, t, None] != keys[None, :, t]
        if not linked.any():
            return
        linked &= x @ x.T >= cosine * norm[:, None] * norm[None, :]
        links = linked @ mult
        if not links.any():
            return
        label = np.arange(len(cid))
        while True:  # the smallest place reachable within the block
            least = np.minimum(label, np.where(linked, label[None, :], len(cid)).min(axis=1))
            if (least == label).all():
                break
            label = least
        at = np.flatnonzero(links)
        yield batch_of(cid[at], links[at].astype(np.int64), cid[label[at]])

    return _grouped(small, large)


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per vector.

    Vectors of equal label, equal length and cosine >= `cosine` are linked. A null label, a null or zero vector, and
    null or non-finite components link with nothing. A null id counts as a link of others but names no component.
    Rows that repeat an id and vector count one by one. Other columns are not read. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = materialize(usable(vectors, id_col, vector_col, label_col).withColumn("hash", F.md5(F.concat_ws("|", F.col("label").cast("string"), F.hex("vec")))), "vectors")
    classes = rows.groupBy("hash").agg(F.min("id").alias("least"), F.count("*").alias("mult"), F.first("dim").alias("dim"), F.first("vec").alias("vec"), F.xxhash64(F.first("label")).alias("lh"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    dim = classes.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if dim is None:
        return vectors.select(F.col(id_col).alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col(id_col).alias("component_id"), F.lit(True).alias("kept"))
    sample = classes.where(F.col("dim") == dim["dim"]).orderBy(F.xxhash64("hash"), "hash").limit(SAMPLE).select("vec").toArrow()
    itq = Itq(_unpack(sample.column(0).combine_chunks() if sample.column(0).num_chunks != 1 else sample.column(0).chunk(0), dim["dim"]), classes.count(), cosine)
    coded = materialize(classes.select("cid", "dim", "vec", "lh").mapInArrow(_tables(itq), "cid long, code long, keys array<bigint>"), "codes")
    dealt = _dealt(coded.select(F.explode("keys").alias("key"), "cid", "code"))
    dealt = dealt.repartition(partitions(dealt), "key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    near = materialize(dealt.mapInArrow(_near_codes(itq.distance), "key long, cid long").distinct(), "near")
    data = classes.select("cid", "mult", "dim", "lh", "vec").join(coded.select("cid", "keys"), "cid")
    dealt = _dealt(near).join(data, "cid").select("key", "bi", "bj", "own", "cid", "mult", "dim", "lh", "vec", "keys")
    dealt = dealt.repartition(partitions(dealt), "key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    found = materialize(dealt.mapInArrow(_links(cosine), "u long, links long, v long"), "links")
    release(near, coded)
    parts = materialize(components(found.select("u", "v")), "parts")
    sums = found.groupBy("u").agg(F.sum("links").alias("links"))
    out = classes.select("hash", "cid", "least", "mult").join(parts, F.col("cid") == F.col("node"), "left").join(sums, F.col("cid") == F.col("u"), "left")
    out = materialize(out.select("hash", F.coalesce("component", "cid").alias("component"), "least", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links")), "found")
    first = out.groupBy("component").agg(F.min("least").alias("component_id"))
    by_class = out.join(first, "component").select("hash", "n_links", "component_id")
    linked = rows.select(F.col("id").alias("vec_id"), "hash").join(by_class, "hash").select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    x = F.transform(vector_col, lambda v: v.cast("double"))
    fine = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0), F.lit(False)) & F.col(label_col).isNotNull()
    alone = vectors.where(~fine).select(F.col(id_col).alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col(id_col).alias("component_id"), F.lit(True).alias("kept"))
    return linked.union(alone)


def op1_itq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach(u, v) AS (
  SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u
), counts AS (SELECT u, count(*) AS n_links FROM links GROUP BY u
), least AS (SELECT u, min(v) AS low FROM reach GROUP BY u)
SELECT e.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, least(coalesce(low, e.vec_id), e.vec_id) AS component_id,
  e.vec_id = least(coalesce(low, e.vec_id), e.vec_id) AS kept
FROM embeddings e LEFT JOIN counts c ON e.vec_id = c.u LEFT JOIN least l ON e.vec_id = l.u
"""
