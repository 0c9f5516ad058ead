"""Embedding near-duplicates by products of int8 tiles.

A unit vector x is stored as codes c (int8) and a scale s with x = s c + e. The length of e is known, so
for two vectors |x.y - s t (c.d)| <= |e| |t d| + |f| |s c| + |e| |f|. Vectors are quantised once, in blocks
whose codes, scales and lengths are one file in the shared folder and whose full vectors are another. Tiles
of codes are multiplied in pieces of at most ``EXACT`` dimensions, over which sums stay below 2**24, so that
float32 products are exact integers. A pair whose upper bound is below the threshold is dismissed, one whose
lower bound is above it is accepted, and only for the others full vectors are read and multiplied in double
precision.

Equal vectors are one vector with a count. Blocks are dealt into S super-blocks; a pair of these is a cell,
and S follows the cores and what a task may hold, so there are as many tasks as the cluster needs and a file
is read S times at most. A cell gives counts of links for its rows and, of its links, only a spanning
forest, so what leaves it is bounded by its rows, not by its pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, discard, local_roots, materialize, shared_dir, spread_join, table
from .files import RangeFile, write_file

SLACK = 1e-6  # covers rounding of the bounds themselves, which are computed in double precision
EXACT = 1024


def quantise(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """codes, scale, length of the coded part and length of the error of unit rows."""
    scale = np.abs(x).max(1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    back = codes * scale[:, None]
    return codes, scale, np.linalg.norm(back, axis=1), np.linalg.norm(x - back, axis=1)


def unit_rows(raw: np.ndarray) -> np.ndarray:
    """Rows in double precision, of length one; scaled first so that squares neither vanish nor overflow."""
    x = raw / np.abs(raw).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


class Block:
    """Vectors of one dimension: ``pack`` makes the two files' bytes, an instance reads them when asked to."""

    def __init__(self, n: int, dim: int, codes_uri: str, full_uri: str):
        self.n, self.dim, self.full_uri, self._full = n, dim, full_uri, None
        raw = _read(codes_uri)
        self.codes = np.frombuffer(raw, np.int8, n * dim).reshape(n, dim)
        self.scale, self.length, self.error, cls, copies = np.frombuffer(raw[n * dim :], np.float64).reshape(5, n)
        self.cls, self.copies = cls.view(np.int64), copies.view(np.int64)

    @staticmethod
    def pack(raw: np.ndarray, cls: np.ndarray, copies: np.ndarray) -> tuple[bytes, bytes]:
        x = unit_rows(raw)
        codes, *numbers = quantise(x)
        return codes.tobytes() + b"".join(v.tobytes() for v in (*numbers, cls, copies)), x.tobytes()

    def rows(self, which: np.ndarray) -> np.ndarray:
        """Full vectors; read from the file when first asked for."""
        if self._full is None:
            self._full = np.frombuffer(_read(self.full_uri), np.float64).reshape(self.n, self.dim)
        return self._full[which]

    def forget(self) -> None:
        self._full = None


def _read(uri: str) -> bytes:
    file = RangeFile(uri)
    data = file.read(0, file.size)
    file.close()
    return data


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows."""
    total = None
    for k in range(0, a.shape[1], EXACT):
        part = a[:, k : k + EXACT].astype(np.float32) @ b[:, k : k + EXACT].astype(np.float32).T
        total = part.astype(np.float64) if total is None else total + part
    return total


def tile_links(a: Block, b: Block, threshold: float, same: bool, step: int = 1024):
    """Linked pairs (i, j) of two blocks, in pieces of at most ``step`` rows of the first."""
    for i in range(0, a.n, step):
        j = slice(i, i + step)
        near = products(a.codes[j], b.codes) * a.scale[j, None] * b.scale
        err = a.error[j, None] * (b.length + b.error) + a.length[j, None] * b.error + SLACK
        if same:
            near[np.tril_indices(near.shape[0], i, near.shape[1])] = -np.inf
        sure = near - err >= threshold
        p, q = np.nonzero((near + err >= threshold) & ~sure)
        on = []
        for k in range(0, len(p), 1 << 16):
            u, v = p[k : k + (1 << 16)], q[k : k + (1 << 16)]
            on.append(np.einsum("ij,ij->i", a.rows(u + i), b.rows(v)) >= threshold)
        keep = np.concatenate(on) if on else np.zeros(0, bool)
        ps, qs = np.nonzero(sure)
        yield np.concatenate([ps, p[keep]]) + i, np.concatenate([qs, q[keep]])


def cell_links(left: list[Block], right: list[Block], same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of two super-blocks: classes with links, how many rows each links with, and the root of each in a
    spanning forest. ``same``: both are one list, of which each pair of blocks is taken once."""
    every = left if same else left + right
    at = np.cumsum([0, *[x.n for x in every]])
    base = 0 if same else len(left)
    links, root = np.zeros(at[-1], np.int64), np.arange(at[-1])
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            if same and j < i:
                continue
            ua, ub = at[i], at[base + j]
            for p, q in tile_links(a, b, threshold, same and i == j):
                links[ua : ua + a.n] += np.bincount(p, b.copies[q], a.n).astype(np.int64)
                links[ub : ub + b.n] += np.bincount(q, a.copies[p], b.n).astype(np.int64)
                if len(p):
                    root = local_roots(len(root), np.concatenate([p + ua, np.arange(len(root))]), np.concatenate([q + ub, root]))
            if a is not b:
                b.forget()
        a.forget()
    cls, on = np.concatenate([x.cls for x in every]), np.flatnonzero(links)
    return cls[on], links[on], cls[root[on]]


def near_duplicates(rows: DataFrame, threshold: float = 0.9, block_rows: int = 2048, held_bytes: int = 64 << 20) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of ``rows`` (``vec_id``, ``embedding``; others
    are not read).

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do
    vectors of different lengths. A null id has no component of its own: its row links like others but
    never names a component, and only one of nulls alone has a null component. Repeated rows are separate
    rows: copies link with each other. An empty table gives no row. A task holds about ``held_bytes`` of
    codes of each side of a cell.
    """
    spark = rows.sparkSession
    folder = f"{shared_dir(spark)}/vectors"
    vec = F.col("embedding").cast("array<double>")
    finite = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    good = F.coalesce((F.size(vec) > 0) & finite & F.exists(vec, lambda v: v != 0), F.lit(False))
    base = materialize(rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(good, F.transform(vec, lambda v: v + F.lit(0.0))).alias("v")), "vectors")
    # equal vectors are one class; an id made here is fixed by being written
    classes = base.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    classes = materialize(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")

    def blocks(batches):
        """Blocks of one partition and dimension: at most block_rows each."""
        held: dict[int, list] = {}

        def write(dim, part):
            raw, cls, copies = (np.concatenate(c) for c in zip(*part))
            codes, full = Block.pack(raw, cls, copies)
            uris = write_file(folder, "codes", codes), write_file(folder, "full", full)
            return pa.RecordBatch.from_pydict({"dim": [dim], "n": [len(cls)], "codes": [uris[0]], "full": [uris[1]]})

        for batch in batches:
            sizes = pa.compute.list_value_length(batch.column("v")).to_numpy()
            for dim in np.unique(sizes).tolist():
                sub = batch.filter(pa.array(sizes == dim))
                flat = sub.column("v").flatten().to_numpy().reshape(-1, dim)
                cls, copies = sub.column("cls").to_numpy(), sub.column("copies").to_numpy()
                i = 0
                while i < len(cls):
                    part = held.setdefault(dim, [])
                    j = i + block_rows - sum(len(c) for _, c, _ in part)
                    part.append((flat[i:j], cls[i:j], copies[i:j]))
                    if j <= len(cls):
                        yield write(dim, held.pop(dim))
                    i = j
        for dim, part in held.items():
            yield write(dim, part)

    n = max(1, classes.count() // block_rows)
    made = classes.select("cls", "copies", "v").coalesce(n).mapInArrow(blocks, "dim long, n long, codes string, full string")
    made = materialize(made, "blocks")
    codes = made.agg(F.sum(F.col("n") * F.col("dim"))).first()[0] or 0
    cores = spark.sparkContext.defaultParallelism
    supers = max(math.ceil(math.sqrt(6 * cores)), -(-codes // held_bytes))
    sides = made.groupBy("dim", F.pmod(F.xxhash64("codes"), F.lit(supers)).alias("part"))
    sides = sides.agg(F.collect_list(F.struct("n", "dim", "codes", "full")).alias("blocks"))  # at most held_bytes of codes, by files
    cells = sides.select("dim", F.col("part").alias("a"), F.col("blocks").alias("left"))
    cells = cells.join(sides.select("dim", F.col("part").alias("b"), F.col("blocks").alias("right")), "dim").where("a <= b")
    cells = cells.select(F.col("a") == F.col("b"), "left", "right").toDF("same", "left", "right").repartition(min(supers * (supers + 1) // 2, 4 * cores))

    def run(batches):
        for batch in batches:
            for same, left, right in zip(*[batch.column(c).to_pylist() for c in ("same", "left", "right")]):
                a = [Block(x["n"], x["dim"], x["codes"], x["full"]) for x in left]
                b = a if same else [Block(x["n"], x["dim"], x["codes"], x["full"]) for x in right]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cell_links(a, b, same, threshold)], ["cls", "links", "root"])

    found = materialize(cells.mapInArrow(run, "cls long, links long, root long"), "links")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    comps = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    joined = classes.join(links, "cls", "left").join(comps.withColumnRenamed("node", "cls"), "cls", "left")
    joined = materialize(joined.withColumn("root", F.coalesce("root", "cls")), "joined")
    discard(found)
    roots = materialize(joined.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "roots")
    named = spread_join(joined, roots.drop("n"), "root", roots.select("root", "n"))
    named = named.select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = spread_join(base.where("v is not null"), materialize(named, "named"), "v", classes.select("v", F.col("copies").alias("n")))
    out = out.select("vec_id", "n_links", "component_id")
    alone = base.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
