"""Suffix-array dedup of long byte matches, by a logarithmic family of indices.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller id.

Every window of ``length`` bytes has an anchor, its k-byte string of least hash (the leftmost of equals).
Equal windows have equal anchors, so windows meet in the bucket of their anchor's hash and matches
cannot be missed between buckets; an anchor that stands once in the corpus has no match and its windows
go no further. In a bucket, the stretches of text around anchors arrive by document id in batches. A batch
gets a suffix array of its windows, by prefix doubling on the bytes; it is merge-scanned against all levels
of the index for strings of ``length`` bytes that both have; what is new becomes a level, and levels of
like size merge, so that there are logarithmically many. Hashes only say what meets where: whether strings
are equal is decided on their bytes.

Documents are packed once into groups of about ``group_bytes``, whatever their ids. Within a group equal
stretches are sent once, so a passage of a third of all documents is sent once a group. An anchor with
``hot_from`` documents or more (a common phrase in ever new surroundings) does not fill one bucket: its
windows are sent one by one, each to the bucket of its own hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_runs, discard, materialize, mix, partitions, release, row_key, table, text_buffers, trim

U = np.uint64
LEVEL = 6  # of the compression of documents, which go through two exchanges and a table
_P = U(0x9E3779B97F4A7C15)


def rolling(x: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n consecutive values along the last axis, by doubling."""
    out, have, power, size, scale = None, 0, x.astype(np.uint64), 1, _P
    width = x.shape[-1]
    todo = n
    while todo:
        if todo & 1:
            m = width - (have + size) + 1
            part = power[..., have : have + m]
            out = part.copy() if out is None else out[..., :m] * scale + part
            have += size
        todo >>= 1
        if todo:
            m = power.shape[-1] - size
            power = power[..., :m] * scale + power[..., size : size + m]
            size *= 2
            with np.errstate(over="ignore"):
                scale = scale * scale
    return out


def anchors(data: np.ndarray, offs: np.ndarray, length: int, k: int):
    """Anchors of runs of documents: (document, first and last window start in the run's bytes, hash of
    the anchor), and the run's bytes, offsets and first document."""
    for i, j in byte_runs(offs, 1 << 19):
        d, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        if len(d) < length:
            continue
        h = mix(rolling(d, k))
        bits = U(len(h).bit_length())
        low = (U(1) << bits) - U(1)
        least, size, w = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1, length - k + 1
        while 2 * size <= w:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < w:
            least = np.minimum(least[: len(least) - (w - size)], least[w - size :])
        where = (least & low).astype(np.int64)
        doc = np.repeat(np.arange(j - i), np.diff(o))[: len(where)]
        valid = np.arange(len(where)) + length <= o[1:][doc]
        p = np.flatnonzero(valid)
        if not len(p):
            continue
        a = where[p]
        new = np.ones(len(p), bool)
        new[1:] = (a[1:] != a[:-1]) | (doc[p][1:] != doc[p][:-1])
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(p)) - 1
        yield i + doc[p[at]], p[at], p[last], h[a[at]], d, o, i


def runs_of(x: np.ndarray):
    """(value, start, end) of each run of equal values."""
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else []
    return [(int(x[i]), i, j) for i, j in zip(at, [*at[1:], len(x)])]


# ---------------------------------------------------------------- the index


def doubled(text: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """For each place of each row: a number by which the ``length`` bytes from it on compare with those of all
    places. Prefix doubling: words of up to eight bytes, then pairs of ranks. Only places that one of a
    row's first ``counts`` windows covers are ranked; what stands elsewhere means nothing."""
    key, size = text.astype(np.uint64), 1
    while size < 8 and 2 * size <= length:
        key = key[:, :-size] << U(8 * size) | key[:, size:]
        size *= 2
    while size < length:
        rank = _ranked(key, np.arange(key.shape[1]) < (counts + length - size)[:, None])
        step = min(size, length - size)
        key = rank[:, :-step] << U(32) | rank[:, step:]
        size += step
    return key


def _ranked(key: np.ndarray, on: np.ndarray) -> np.ndarray:
    flat = key[on]
    order = np.argsort(flat)
    put = np.zeros(len(flat), np.uint64)
    put[1:] = flat[order][1:] != flat[order][:-1]
    ranks = np.empty(len(flat), np.uint64)
    ranks[order] = np.cumsum(put, dtype=np.uint64)
    out = np.zeros(key.shape, np.uint64)
    out[on] = ranks
    return out


class SuffixArray:
    """The distinct windows of a batch in the order of their bytes, each with the least document it starts in.

    text: rows of bytes; counts: how many windows of each row count, from its first byte on; docs: the
    rows' documents, ascending. ``places`` are all counted windows as (row, column), row by row, and
    ``group`` says which of the distinct ones each is."""

    def __init__(self, text: np.ndarray, counts: np.ndarray, docs: np.ndarray, length: int):
        windows = np.lib.stride_tricks.sliding_window_view(text, length, axis=1)
        self.places = np.nonzero(np.arange(windows.shape[1]) < counts[:, None])
        key = doubled(text, counts, length)[self.places]
        order = np.argsort(key, kind="stable")  # of equal ones the least document comes first
        first = np.ones(len(order), bool)
        first[1:] = key[order][1:] != key[order][:-1]
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.cumsum(first) - 1
        row, column = (p[order[first]] for p in self.places)
        self.keys = np.ascontiguousarray(windows[row, column]).view(f"S{length}").ravel()
        self.docs = docs[row]


class IndexFamily:
    """Levels of suffix arrays: (sorted distinct strings, least documents). Each batch is scanned against
    them, then added; a level at least as large as half of the one before it merges with it."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, batch: SuffixArray) -> np.ndarray:
        """The least document of each distinct string of the batch, over all batches so far."""
        least, known = batch.docs.copy(), np.zeros(len(batch.keys), bool)
        for keys, docs in self.levels:
            k = np.searchsorted(keys, batch.keys)
            k[k == len(keys)] = 0
            hit = keys[k] == batch.keys
            least[hit] = np.minimum(least[hit], docs[k[hit]])
            known |= hit
        level = (batch.keys[~known], batch.docs[~known])
        while len(level[0]) and self.levels and len(self.levels[-1][0]) <= 2 * len(level[0]):
            level = self._merge(self.levels.pop(), level)
        if len(level[0]):
            self.levels.append(level)
        return least

    @staticmethod
    def _merge(a, b):
        """Two levels, which have no string in common, as one."""
        n = len(a[0]) + len(b[0])
        at = np.searchsorted(a[0], b[0]) + np.arange(len(b[0]))
        rest = np.ones(n, bool)
        rest[at] = False
        out = []
        for x, y in zip(a, b):
            both = np.empty(n, x.dtype)
            both[at], both[rest] = y, x
            out.append(both)
        return tuple(out)


def repeated_windows(text: np.ndarray, counts: np.ndarray, docs: np.ndarray, length: int, batch: int):
    """For rows in the order of their documents: (row, first, last) of those with windows that also start in
    a smaller document, first and last of these windows."""
    family = IndexFamily()
    for i in range(0, len(text), batch):
        part = SuffixArray(text[i : i + batch], counts[i : i + batch], docs[i : i + batch], length)
        row, column = part.places
        hit = family.add(part)[part.group] < docs[i + row]
        row, column = row[hit], column[hit]
        for r, a, b in runs_of(row):
            yield i + r, int(column[a]), int(column[b - 1])


# ---------------------------------------------------------------- the passes


def _documents(blob: bytes) -> pa.Table:
    """A group's documents, by id and row key, those without an id last."""
    return pa.ipc.open_stream(pa.py_buffer(blob)).read_all()


def _known(docs: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, bytes and offsets of a group's documents that have an id."""
    n = docs.num_rows - docs.column("doc_id").null_count
    data, offs = text_buffers(docs.column("text").slice(0, n))
    return docs.column("doc_id").slice(0, n).to_numpy(), data, offs


def packed_groups(rows: DataFrame, groups: int) -> DataFrame:
    """One row for each group of documents: grp, and its documents as compressed Arrow data. A row goes to
    any group, whatever its id, so that no id, null neither, fills one."""
    grp = F.pmod(F.xxhash64("row_key", F.spark_partition_id(), F.monotonically_increasing_id()), F.lit(groups))

    def pack(docs: pa.Table) -> pa.Table:
        grp, sink = docs.column("grp")[0].as_py(), pa.BufferOutputStream()
        docs = docs.drop_columns(["grp"]).sort_by([("doc_id", "ascending"), ("row_key", "ascending")]).combine_chunks()
        with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", LEVEL))) as out:
            out.write_table(docs)
        return pa.table({"grp": pa.array([grp], pa.int64()), "docs": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    return materialize(rows.withColumn("grp", grp).groupBy("grp").applyInArrow(pack, "grp long, docs binary"), "groups")


def living_anchors(packed: DataFrame, buckets: int, length: int, k: int, hot_from: int) -> DataFrame:
    """Anchors that two documents or more have: grp, bucket, and arrays of the hashes' upper halves and of
    whether they are hot, for each group that has them."""

    def hashes(batches):
        for batch in batches:
            for grp, blob in zip(batch.column("grp").to_pylist(), batch.column("docs")):
                _, data, offs = _known(_documents(blob.as_py()))
                found = [(h, doc) for doc, _, _, h, *_ in anchors(data, offs, length, k)]
                if not found:
                    continue
                h, doc = map(np.concatenate, zip(*found))
                order = np.lexsort((doc, h))
                h, doc = h[order], doc[order]
                once = np.ones(len(h), bool)  # repeats within a document do not count
                once[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                h, n = np.unique(h[once], return_counts=True)
                bucket, high, n = (h & U(0xFFFFFFFF)) % U(buckets), (h >> U(32)).astype(np.uint32), np.minimum(n, 65535).astype(np.uint16)
                order = np.argsort(bucket, kind="stable")
                out = [(b, order[i:j]) for b, i, j in runs_of(bucket[order])]
                cols = {"bucket": [b for b, _ in out], "grp": [grp] * len(out), "high": [high[x].tobytes() for _, x in out], "n": [n[x].tobytes() for _, x in out]}
                del data, found, h, doc
                trim()
                yield pa.RecordBatch.from_pydict(cols)

    def survivors(entries: pa.Table) -> pa.Table:
        bucket = entries.column("bucket")[0].as_py()
        high, n = (np.frombuffer(b"".join(entries.column(c).to_pylist()), t) for c, t in (("high", np.uint32), ("n", np.uint16)))
        g = np.repeat(entries.column("grp").to_numpy(), [len(x) // 4 for x in entries.column("high").to_pylist()])
        _, at, total = np.unique(high, return_inverse=True, return_counts=True)
        total = np.bincount(at, n, len(total))[at]
        on = total >= 2
        high, g, hot = high[on], g[on], total[on] >= hot_from
        order = np.argsort(g, kind="stable")
        out = [(x, order[i:j]) for x, i, j in runs_of(g[order])]
        cols = {"grp": pa.array([x for x, _ in out], pa.int64()), "bucket": pa.array([bucket] * len(out), pa.int64())}
        return pa.table(cols | {name: pa.array([v[x].tobytes() for _, x in out], pa.binary()) for name, v in (("high", high), ("hot", hot))})

    entries = packed.mapInArrow(hashes, "bucket long, grp long, high binary, n binary")
    return materialize(entries.groupBy("bucket").applyInArrow(survivors, "grp long, bucket long, high binary, hot binary"), "anchors")


def repeated_spans(packed: DataFrame, buckets: int, length: int, k: int, hot_from: int, batch: int = 1 << 14) -> DataFrame:
    """Runs of repeated windows, packed: grp, and arrays of the document's place in its group, start, end."""
    alive = living_anchors(packed, buckets, length, k, hot_from)
    release(packed.sparkSession)
    width = 2 * length - k
    binaries = ("bytes", "doc_ids", "places", "starts", "counts", "known")
    schema = "bucket long, grp long, " + ", ".join(f"{c} binary" for c in binaries)

    def stretches(docs: pa.Table, own: pa.Table) -> pa.Table:
        empty = pa.table({c: pa.array([], pa.binary() if c in binaries else pa.int64()) for c in ("bucket", "grp", *binaries)})
        if not docs.num_rows or not own.num_rows:
            return empty
        grp = docs.column("grp")[0].as_py()
        ids, data, offs = _known(_documents(docs.column("docs")[0].as_py()))
        keys = np.concatenate([U(b << 32) | np.frombuffer(h, np.uint32).astype(np.uint64) for b, h in zip(own.column("bucket").to_pylist(), own.column("high").to_pylist())])
        hot = np.frombuffer(b"".join(own.column("hot").to_pylist()), bool)
        order = np.argsort(keys)
        keys, hot = keys[order], hot[order]
        found: list[tuple] = []
        for doc, first, last, h, d, o, base in anchors(data, offs, length, k):
            bucket = (h & U(0xFFFFFFFF)) % U(buckets)
            key = bucket << U(32) | h >> U(32)
            at = np.searchsorted(keys, key)
            at[at == len(keys)] = 0
            on = keys[at] == key
            for single in (False, True):
                pick = np.flatnonzero(on & (hot[at] == single))
                if not len(pick):
                    continue
                n = last[pick] - first[pick] + 1
                where, start = bucket[pick], first[pick]
                if single:  # a window of its own for each
                    start = np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    pick, n = np.repeat(pick, n), np.ones(len(start), np.int64)
                span = np.minimum(start[:, None] + np.arange(width), len(d) - 1)
                cut = np.where(np.arange(width) < (n + length - 1)[:, None], d[span], 0).astype(np.uint8)
                sign = mix(rolling(cut, width)[:, 0] + n.astype(np.uint64))
                if single:
                    where = sign % U(buckets)
                found.append((where.astype(np.int64), cut, doc[pick], start - o[doc[pick] - base], n.astype(np.uint8), sign))
        if not found:
            return empty
        bucket, cut, doc, start, n, sign = map(np.concatenate, zip(*found))
        found.clear()
        order = np.lexsort((doc, sign))  # documents stand in the order of their ids
        head = np.ones(len(order), bool)
        head[1:] = (sign[order][1:] != sign[order][:-1]) | (n[order][1:] != n[order][:-1])
        same = np.flatnonzero(~head)
        head[same] = (cut[order[same]] != cut[order[same - 1]]).any(1)
        lead = ids[doc[order[np.flatnonzero(head)[np.cumsum(head) - 1]]]]
        known = np.zeros(len(order), bool)
        known[order] = lead < ids[doc[order]]
        send, pack = np.flatnonzero(~known), zstandard.ZstdCompressor(level=3).compress
        send = send[np.argsort(bucket[send], kind="stable")]
        there = np.flatnonzero(known)
        spans = [doc[there].astype(np.int32), start[there].astype(np.int64), start[there] + n[there].astype(np.int64) + length - 1]
        out = [(b, send[i:j]) for b, i, j in runs_of(bucket[send])]
        cols = {
            "bucket": [b for b, _ in out],
            "grp": [grp] * len(out),
            "bytes": [pack(cut[x].tobytes()) for _, x in out],
            "doc_ids": [pack(np.diff(ids[doc[x]], prepend=0).tobytes()) for _, x in out],
            "places": [pack(np.diff(doc[x], prepend=0).astype(np.int32).tobytes()) for _, x in out],
            "starts": [pack(np.diff(start[x], prepend=0).astype(np.int32).tobytes()) for _, x in out],
            "counts": [pack(n[x].tobytes()) for _, x in out],
            "known": [b""] * len(out),
        }
        if len(there):  # what is known here goes along, to come out with the rest
            row = {"bucket": grp % buckets, "grp": grp, "known": b"".join(s.tobytes() for s in spans)}
            for c in cols:
                cols[c].append(row.get(c, b""))
        del cut, found
        trim()
        return pa.table(cols, schema=empty.schema)

    sent = packed.groupBy("grp").cogroup(alive.groupBy("grp")).applyInArrow(stretches, schema)

    def match(parts: pa.Table) -> pa.Table:
        out = [(g, s) for g, s in zip(parts.column("grp").to_pylist(), parts.column("known").to_pylist()) if s]
        column = lambda c: [v for v in parts.column(c).to_pylist() if v]
        unpack = zstandard.ZstdDecompressor().decompress
        counts = [unpack(c) if c else b"" for c in parts.column("counts").to_pylist()]
        grps = np.repeat(parts.column("grp").to_numpy(), [len(c) for c in counts])
        gaps = lambda c, t: np.concatenate([np.cumsum(np.frombuffer(unpack(v), t)) for v in column(c)] or [np.zeros(0, t)])
        cut = np.frombuffer(b"".join(map(unpack, column("bytes"))), np.uint8).reshape(-1, width)
        ids, places = gaps("doc_ids", np.int64), gaps("places", np.int32).astype(np.int32)
        starts, n = gaps("starts", np.int32).astype(np.int64), np.frombuffer(b"".join(counts), np.uint8)
        order = np.argsort(ids, kind="stable")
        hits = list(repeated_windows(cut[order], n[order].astype(np.int64), ids[order], length, batch))
        del cut
        trim()
        if hits:
            row, low, high = (np.array(x) for x in zip(*hits))
            row = order[row]
            # the first and the last repeated window overlap or touch, so they cover all between
            g, p, a, b = grps[row], places[row], starts[row] + low, starts[row] + high + length
            by = np.argsort(g, kind="stable")
            for grp, i, j in runs_of(g[by]):
                x = by[i:j]
                out.append((grp, p[x].astype(np.int32).tobytes() + a[x].astype(np.int64).tobytes() + b[x].astype(np.int64).tobytes()))
        return pa.table({"grp": pa.array([g for g, _ in out], pa.int64()), "spans": pa.array([s for _, s in out], pa.binary())})

    spans = materialize(sent.groupBy("bucket").applyInArrow(match, "grp long, spans binary"), "spans")
    del sent
    discard(alive)
    release(packed.sparkSession)
    return spans


def remove_repeats(docs: DataFrame, length: int = 50, k: int = 20, group_bytes: int = 4 << 20, hot_from: int = 1 << 16, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row of ``docs`` (``doc_id``, ``text``;
    others are not read), and, if ``keep`` names columns, these and ``kept_text`` (characters cut in two are
    dropped).

    Null and empty texts have no bytes. A null id is neither smaller nor larger than any, so its row loses
    nothing and takes nothing from others. Equal ids take nothing from each other; rows that repeat an id
    and text lose the same. An empty table gives no row. ``group_bytes`` and ``hot_from`` change only what
    is done where.
    """
    if not 0 < k < length or length - k + 1 > min(length, 255):
        raise ValueError("k must be positive and below length")
    spark = docs.sparkSession
    others = [c for c in keep if c not in ("doc_id", "text")]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), text.alias("text"), *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(others)])
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    groups = max(partitions(spark), -(-total // group_bytes))
    packed = packed_groups(rows, groups)
    release(spark)
    spans = repeated_spans(packed, 2 * groups, length, k, hot_from)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *others, *["kept_text"] * bool(keep)]
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + "".join(f", `{c}` {types[f'keep_{i}']}" for i, c in enumerate(others)) + ", kept_text string" * bool(keep)

    def cut(docs: pa.Table, own: pa.Table) -> pa.Table:
        rows = _documents(docs.column("docs")[0].as_py())
        data, offs = text_buffers(rows.column("text"))
        raw = own.column("spans").to_pylist()
        sizes = [len(x) // 20 for x in raw]
        place = np.concatenate([np.frombuffer(x, np.int32, m) for x, m in zip(raw, sizes)] or [np.zeros(0, np.int32)])
        first = np.concatenate([np.frombuffer(x, np.int64, m, 4 * m) for x, m in zip(raw, sizes)] or [np.zeros(0, np.int64)])
        last = np.concatenate([np.frombuffer(x, np.int64, m, 12 * m) for x, m in zip(raw, sizes)] or [np.zeros(0, np.int64)])
        order = np.argsort(place, kind="stable")
        place, first, last = place[order], first[order], last[order]
        at = np.searchsorted(place, np.arange(rows.num_rows + 1))
        removed, runs, digests, kept = np.zeros(rows.num_rows, np.int64), np.zeros(rows.num_rows, np.int64), [], []
        for r in range(rows.num_rows):
            text, i, j = data[offs[r] : offs[r + 1]], at[r], at[r + 1]
            if i < j:
                mark = np.zeros(len(text) + 1, np.int32)
                np.add.at(mark, first[i:j], 1)
                np.add.at(mark, last[i:j], -1)
                gone = np.cumsum(mark[:-1], dtype=np.int32) > 0
                removed[r] = gone.sum()
                runs[r] = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                text = text[~gone]
            digests.append(hashlib.sha256(text).hexdigest())
            if keep:
                kept.append(text.tobytes().decode("utf-8", "ignore"))
        cols = [rows.column("doc_id"), pa.array(np.diff(offs)), pa.array(removed), pa.array(runs), pa.array(digests, pa.string()), *[rows.column(f"keep_{i}") for i in range(len(others))]]
        trim()
        return pa.table(cols + [pa.array(kept, pa.string())] * bool(keep), names=names)

    return packed.groupBy("grp").cogroup(spans.groupBy("grp")).applyInArrow(cut, schema)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
