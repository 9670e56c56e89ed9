"""Shared pieces of the training-data operators: tables, shared storage, byte views of Arrow columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space that separates words everywhere in this subpackage: blank and \x09 to \x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a local session without the setting gets one of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = getattr(shared_dir, "own", None)
    if path is None:
        path = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return path


def _files(spark: SparkSession, path: str):
    """The path and its file system, as the driver's JVM has them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends in files that outlive any executor.

    The files go when release() is called, or else when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at, files = _files(spark, path)
    files.deleteOnExit(at)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes what materialize() wrote for these tables; nothing may read them, or what is derived from them, any more."""
    for df in tables:
        at, files = _files(df.sparkSession, df._written)
        files.delete(at, True)


def extended(schema: T.StructType, more: str) -> T.StructType:
    """schema with further columns, given as DDL."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(more).fields])


def shielded(docs: DataFrame, used: list[str], step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """step(docs), with the columns that it doesn't use under other names meanwhile, so that none clashes with its own.

    A column of docs that is named like one that step adds gives way to it.
    """
    other = {c: f"_other{i}" for i, c in enumerate(docs.columns) if c not in used}
    if not other:
        return step(docs)
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    out = step(docs.select(*[quoted(c).alias(other.get(c, c)) for c in docs.columns]))
    back = {n: c for c, n in other.items()}
    added = {c.lower() for c in out.columns if c not in back}
    return out.select(*[quoted(c).alias(back.get(c, c)) for c in out.columns if back.get(c, "").lower() not in added])


def partitions(df: DataFrame) -> int:
    """Shuffle partitions of the session, for repartition by a key."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without decoding it; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes; a longer text stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words (splitmix finaliser)."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_ODD = np.uint64(0x9E3779B97F4A7C15)
_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least n of each."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        with np.errstate(over="ignore"):
            for name, base in (("up", _ODD), ("down", inverse)):
                out = np.full(size, base, np.uint64)
                out[0] = 1
                _powers[name] = np.cumprod(out)
    return _powers["up"], _powers["down"]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of values[byte j] * base**j over j < i; a substring's hash follows from two entries."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_VALUES[data] * up[: len(data)], out=out[1:])
    return out


def substring_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    with np.errstate(over="ignore"):
        return mix64((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every word; words never cross documents."""
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] = solid[heads]
    tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[tails] = solid[tails]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document, 64-bit hash of the word with A-Z lower-cased)."""
    start, end, doc = words(data, offsets)
    return start, end, doc, substring_hash(prefix_hash(_LOWER[data]), start, end)


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Whole groups of a stream sorted by its first `keys` columns (integers), one at a time."""
    held: list[pa.Table] = []
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not t.num_rows:
            continue
        key = np.column_stack([t.column(i).to_numpy() for i in range(keys)])
        edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            part = t.slice(a, b - a)
            if held and any(held[-1].column(i)[-1].as_py() != part.column(i)[0].as_py() for i in range(keys)):
                yield pa.concat_tables(held)
                held = []
            held.append(part)
    if held:
        yield pa.concat_tables(held)
