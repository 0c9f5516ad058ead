"""What the operators share: the shared folder, Arrow text buffers, hashing and components."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LIBC = ctypes.CDLL(None)
U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_M1, _M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


# ---------------------------------------------------------------- shared folder


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver see, as a full URI: the one that ``spark.checkpoint.dir``
    names, on the cluster's default file system if it has no scheme. Where none is set, a local session
    gets a temporary folder of its own, and any other an error."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quoin-"))
    return re.sub("^file:/+", "file:///", f"{context.getCheckpointDir()}/quoin")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage is cut, and a
    lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    frame = spark.read.schema(df.schema).parquet(path)
    frame.table_path = path
    return frame


def discard(*frames: DataFrame) -> None:
    """Delete materialized tables once all that reads them has been written itself."""
    for frame in frames:
        system, path = fs.FileSystem.from_uri(frame.table_path)
        system.delete_dir(path)


def release(spark: SparkSession) -> None:
    """Have Spark's cleaner drop the shuffle files of frames that are no longer referenced. It learns of
    them only when the driver's JVM collects garbage, which a driver at rest does not do by itself, and
    until then the executors' disks hold them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """Give freed memory back to the system. Python workers live on from task to task and stage to stage, and
    what an allocator keeps for itself there is taken from the executor."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key():
    """What joins a decision back to its rows: id and text, so that rows that repeat an id with another
    text keep their own decision, and a null id has one."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread_join(rows: DataFrame, keyed: DataFrame, key: str, counts: DataFrame, share: int = 1000) -> DataFrame:
    """``rows`` joined with ``keyed``, which has one row for each of their keys, so that no key fills a task.
    Keys with more than one in ``share`` of all rows (counts: ``key``, ``n``), fewer than ``share`` of them
    then, are broadcast with their rows; the others are joined by a shuffle."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(counts.where(F.col("n") * share > total).select(key))
    frequent = F.broadcast(keyed.join(hot, key, "left_semi"))
    return rows.join(frequent, key).unionByName(rows.join(hot, key, "left_anti").join(keyed, key))


# ---------------------------------------------------------------- arrow and hashing


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    _, offs, data = col.buffers()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def byte_runs(offsets: np.ndarray, limit: int):
    """Consecutive runs (i, j) of documents of about ``limit`` bytes, whole documents only."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> U(30))) * _M1
    x = (x ^ (x >> U(27))) * _M2
    return x ^ (x >> U(31))


def _powers(n: int, base: int) -> np.ndarray:
    p = np.full(n, U(base % 2**64), np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


class _Pow:
    up = _powers(1, _P)
    down = _powers(1, pow(_P, -1, 2**64))

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = _powers(n, _P), _powers(n, pow(_P, -1, 2**64))
        return cls.up[:n], cls.down[:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all documents, and for each document
    the range of its words. A-Z are lower-cased if asked."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    edge = np.ones(n + 1, bool)
    edge[1:n] = space[:-1]
    edge[offsets[:-1]] = True
    edge[n] = True
    word = ~space
    starts = np.flatnonzero(word & edge[:n])
    last = np.ones(n, bool)
    last[:-1] = edge[1:n] | space[1:]
    ends = np.flatnonzero(word & last) + 1
    up, down = _Pow.of(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(((_LOWER[data] if lower else data).astype(np.uint64) + U(1)) * up, out=total[1:])
    h = (total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * U(0xD6E8FEB86659FD93)
    return mix(h), np.searchsorted(starts, offsets)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each component of the graph on 0..n-1 with edges (a, b)."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        on = low != high
        if not on.any():
            break
        a, b, low, high = a[on], b[on], low[on], high[on]
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


# ---------------------------------------------------------------- components


def _contracted(edges: DataFrame) -> DataFrame:
    """The edges of each partition as stars around the smallest nodes of its own components: never more
    edges than before, and the same components overall."""

    def run(batches):
        parts = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
        if not parts:
            return
        a, b = (np.concatenate(x) for x in zip(*parts))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = local_roots(len(nodes), at[: len(a)], at[len(a) :])
        on = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[on]), pa.array(nodes[root[on]])], ["a", "b"])

    return edges.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges (a, b)``: rows (node, root), root the smallest node; only
    nodes with edges.

    Contracts within partitions, then alternates large-star and small-star steps. Neighbourhood minima are partial aggregates and the
    joins on a node are plain equi-joins that adaptive execution can split, so a hub with a third of
    all edges is not gathered in one task. Every round is a table in the shared folder.
    """
    spark = edges.sparkSession
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    cur = materialize(_contracted(pairs), "cc")
    seen = None
    while True:
        sign = cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(sign) == seen or not sign[0]:
            return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        seen, before = tuple(sign), cur
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = small.unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        # fewer edges meet in fewer partitions, of about as many edges each, and contract further there
        cur = materialize(_contracted(edges.coalesce(8 + sign[0] // 50_000)), "cc")
        discard(before)
