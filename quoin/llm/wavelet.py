"""Token shards as wavelet matrices.

A shard file holds the ids of consecutive documents as a wavelet matrix: one bit-plane for each bit of
the alphabet, most significant first, each plane ordered by the planes before it (zeros first). Planes
are cut into blocks of ``BLOCK`` bits that are compressed apart, and a directory has the ones before
each block, so ``access``, ``rank``/``count`` and ``select``/``locate`` touch a few blocks for each plane.

Layout: blocks | doc ids (int64) | doc starts (int64) | directory | footer (fixed size).
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder
from .common import materialize, partitions, shared_dir, table, text_buffers
from .files import RangeFile, write_file

MAGIC, BLOCK = b"QWM1", 1 << 19
END_ID = 0
_FOOT = struct.Struct("<QQQ4s")


def build(ids: np.ndarray, bits: int, doc_ids: np.ndarray, starts: np.ndarray) -> bytes:
    """The file for ``ids`` (each under 2**bits) of the documents that begin at ``starts``."""
    pack = zstandard.ZstdCompressor(level=1).compress
    s = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    out, at, planes = [], 0, []
    for level in range(bits - 1, -1, -1):
        bit = (s >> level) & 1
        blocks, before = [], 0
        for i in range(0, len(s), BLOCK):
            part = bit[i : i + BLOCK]
            data = pack(np.packbits(part.astype(np.uint8)).tobytes())
            blocks.append([at, len(data), before])
            before += int(part.sum(dtype=np.int64))
            out.append(data)
            at += len(data)
        planes.append({"zeros": len(s) - before, "blocks": blocks})
        one = bit.view(bool) if bit.dtype == np.uint8 else bit.astype(bool)
        s = np.concatenate([s[~one], s[one]])
    docs = pack(np.ascontiguousarray(doc_ids, np.int64).tobytes()), pack(np.ascontiguousarray(starts, np.int64).tobytes())
    head = pack(json.dumps({"n": len(ids), "bits": bits, "docs": [len(d) for d in docs], "planes": planes}).encode())
    return b"".join([*out, *docs, head, _FOOT.pack(at, sum(map(len, docs)), len(head), MAGIC)])


class WaveletShard:
    """Reads one shard; only the blocks asked for are fetched, and at most ``hold`` are kept."""

    def __init__(self, uri: str, hold: int = 64):
        self.file, self.hold, self.held = RangeFile(uri), hold, {}
        at, docs, head, magic = _FOOT.unpack(self.file.read(self.file.size - _FOOT.size, _FOOT.size))
        if magic != MAGIC:
            raise ValueError(f"not a wavelet shard: {uri}")
        unpack = zstandard.ZstdDecompressor().decompress
        about = json.loads(unpack(self.file.read(at + docs, head)))
        self.n, self.bits, self.planes = about["n"], about["bits"], about["planes"]
        a, b = about["docs"]
        self.doc_ids = np.frombuffer(unpack(self.file.read(at, a)), np.int64)
        self.starts = np.frombuffer(unpack(self.file.read(at + a, b)), np.int64)

    def _block(self, level: int, k: int) -> np.ndarray:
        if (level, k) not in self.held:
            if len(self.held) >= self.hold:
                self.held.clear()
            at, size, _ = self.planes[level]["blocks"][k]
            raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.file.read(at, size)), np.uint8)
            self.held[level, k] = np.unpackbits(raw)[: min(BLOCK, self.n - k * BLOCK)]
        return self.held[level, k]

    def _bit(self, level: int, i: int) -> int:
        return int(self._block(level, i // BLOCK)[i % BLOCK])

    def _ones(self, level: int, i: int) -> int:
        """Ones before place i of a plane."""
        blocks = self.planes[level]["blocks"]
        if i >= self.n:
            return self.n - self.planes[level]["zeros"]
        return blocks[i // BLOCK][2] + int(self._block(level, i // BLOCK)[: i % BLOCK].sum(dtype=np.int64))

    def access(self, i: int) -> int:
        """The id at place i."""
        value = 0
        for level in range(self.bits):
            bit, ones = self._bit(level, i), self._ones(level, i)
            value = value << 1 | bit
            i = self.planes[level]["zeros"] + ones if bit else i - ones
        return value

    def _range(self, token: int, i: int, j: int) -> tuple[int, int]:
        for level in range(self.bits):
            a, b = self._ones(level, i), self._ones(level, j)
            if token >> (self.bits - 1 - level) & 1:
                zeros = self.planes[level]["zeros"]
                i, j = zeros + a, zeros + b
            else:
                i, j = i - a, j - b
        return i, j

    def count(self, token: int, i: int = 0, j: int | None = None) -> int:
        """How often ``token`` stands in places i to j."""
        a, b = self._range(token, i, self.n if j is None else j)
        return b - a

    def _select(self, level: int, bit: int, k: int) -> int:
        """The place of the k-th (from 0) ``bit`` of a plane."""
        blocks = self.planes[level]["blocks"]
        low, high = 0, len(blocks) - 1
        while low < high:
            mid = (low + high + 1) // 2
            before = blocks[mid][2] if bit else mid * BLOCK - blocks[mid][2]
            low, high = (mid, high) if before <= k else (low, mid - 1)
        before = blocks[low][2] if bit else low * BLOCK - blocks[low][2]
        return low * BLOCK + int(np.flatnonzero(self._block(level, low) == bit)[k - before])

    def locate(self, token: int) -> Iterator[int]:
        """The places of ``token``, ascending."""
        a, b = self._range(token, 0, self.n)
        for i in range(a, b):
            for level in range(self.bits - 1, -1, -1):
                bit = token >> (self.bits - 1 - level) & 1
                i = self._select(level, bit, i - self.planes[level]["zeros"] * bit)
            yield i

    def decode(self) -> np.ndarray:
        """All ids, by undoing the planes from the last to the first."""
        s = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            plane = self.planes[level]
            at, zeros = plane["blocks"], plane["zeros"]
            bit = np.concatenate([self._block(level, k) for k in range(len(at))]).view(bool) if at else np.zeros(0, bool)
            up = np.empty_like(s)
            up[~bit] = s[:zeros]
            up[bit] = s[zeros:] | s.dtype.type(1 << (self.bits - 1 - level))
            s = up
        return s

    def close(self) -> None:
        self.file.close()


def write_shards(docs: DataFrame, folder: str, path: str | None = None, bits: int = 16, shard_tokens: int = 2_000_000, shards: int | None = None) -> DataFrame:
    """Encode all texts, end id after each, and write them as shards in ascending ``doc_id`` order.

    docs: ``doc_id``, ``text`` and any others, which are not read. Null and empty texts give the end id
    alone; null ids come first, in a file too (as the least long); equal ids keep all their rows; an
    empty table gives no shard. Returns the manifest (part, seq, uri, n_tokens, n_docs): only files in
    it belong to the result, so repeated task attempts do no harm. A task holds about ``shard_tokens``
    ids at once, besides one document. An id of more than ``bits`` bits is an error.
    """
    spark = docs.sparkSession
    least = -(2**63)

    def write(batches):
        enc, part, seq = encoder(path), TaskContext.get().partitionId(), 0
        ids, lengths, names, held = [], [], [], 0

        def flush():
            nonlocal seq, held
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            uri = write_file(folder, f"tokens-{part:06d}-{seq:06d}", build(np.concatenate(ids), bits, np.array(names), starts))
            row = pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "uri": [uri], "n_tokens": [held], "n_docs": [len(names)]})
            ids.clear(), lengths.clear(), names.clear()
            seq, held = seq + 1, 0
            return row

        for batch in batches:
            for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                got = np.append(enc.encode(text.as_py() or ""), np.uint32(END_ID))
                if int(got.max()) >> bits:
                    raise ValueError(f"id {got.max()} has more than {bits} bits")
                ids.append(got.astype(np.uint16 if bits <= 16 else np.uint32))
                lengths.append(len(got))
                names.append(least if name is None else name)
                held += len(got)
                if held >= shard_tokens:
                    yield flush()
        if names:
            yield flush()

    n = shards or partitions(spark)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = ordered.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    return materialize(ordered.mapInArrow(write, "part long, seq long, uri string, n_tokens long, n_docs long"), "shards")


def read_shards(manifest: DataFrame) -> DataFrame:
    """One row for each document, from the files: doc_id, start, n_tokens, ids_crc32."""
    import zlib

    from pyspark.sql import Window as W

    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # the order of all files is that of parts, of which there are as many as range partitions, then of files within one
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).select("part", before(W.orderBy("part")).alias("first"))
    based = manifest.join(parts, "part").withColumn("base", F.col("first") + before(W.partitionBy("part").orderBy("seq")))

    def read(batches):
        for batch in batches:
            for uri, base in zip(batch.column("uri").to_pylist(), batch.column("base").to_pylist()):
                shard = WaveletShard(uri)
                ids = shard.decode().astype("<u4")
                ends = np.append(shard.starts[1:], shard.n)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(shard.doc_ids, mask=shard.doc_ids == -(2**63)),
                        "start": shard.starts + base,
                        "n_tokens": ends - shard.starts,
                        "ids_crc32": pa.array([zlib.crc32(ids[a:b]) for a, b in zip(shard.starts, ends)], pa.int64()),
                    }
                )
                shard.close()

    n = max(1, min(manifest.count(), 4 * partitions(manifest.sparkSession)))
    return based.select("uri", "base").repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as wavelet-matrix shards, read back."""
    folder = f"{shared_dir(spark)}/token-shards"
    return read_shards(write_shards(table(spark, sf_dir, "documents"), folder))
