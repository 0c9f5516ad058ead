"""Best-fit packing of documents into sequences, refined by swaps between underfull bins.

Only lengths matter for what goes together, and there are at most ``capacity`` of them. So the whole
corpus is packed on its histogram: a bin is a multiset of lengths, and equal bins are one pattern with
a multiplicity. The histogram, the patterns and the search are bounded by the capacity whatever the
number of documents; pieces then take their places by their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder
from .common import materialize, table, trim

CAPACITY, END_ID = 1024, 2
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def best_fit(histogram: dict[int, int], capacity: int) -> Counter:
    """Best-fit decreasing on the histogram: patterns (descending lengths) and their multiplicities.

    All pieces of one length are placed before the next shorter ones; bins of equal content are opened
    and filled together. A piece goes to the fullest bin it fits.
    """
    done: Counter = Counter()
    room: dict[int, Counter] = {}
    order: list[int] = []  # the rooms left, ascending

    def put(pattern: tuple, left: int, n: int) -> None:
        if not left:
            done[pattern] += n
            return
        if left not in room:
            room[left] = Counter()
            insort(order, left)
        room[left][pattern] += n

    for size in sorted(histogram, reverse=True):
        n = histogram[size]
        while n:
            k = bisect_left(order, size)
            if k == len(order):  # open bins: as many pieces in each as fit
                per = max(1, capacity // size)
                whole, rest = divmod(n, per)
                if whole:
                    put((size,) * per, capacity - size * per, whole)
                if rest:
                    put((size,) * rest, capacity - size * rest, 1)
                break
            left = order[k]
            pattern, have = next(iter(room[left].items()))
            per = min(left // size, n)
            bins = min(have, n // per)
            room[left][pattern] -= bins
            if not room[left][pattern]:
                del room[left][pattern]
            if not room[left]:
                del room[left]
                order.pop(k)
            put((*pattern, *(size,) * per), left - per * size, bins)
            n -= bins * per
    for left in room.values():
        done.update(left)
    return done


def improve(patterns: Counter, capacity: int) -> Counter:
    """Swap-based local search among underfull bins.

    The emptiest bin gives its pieces away: a move to another bin, else an exchange of one of its
    pieces for a shorter one, of one for two shorter ones, or of two for one shorter than both together,
    of another bin. Each step moves tokens from an emptier to a fuller bin, so the sum of squared fills
    grows and the search ends, when no step gains; a bin that has become empty is gone. Steps act on
    whole multiplicities of equal bins.
    """
    fill = {p: sum(p) for p in patterns}
    full = Counter({p: n for p, n in patterns.items() if fill[p] == capacity})
    open_ = {p: n for p, n in patterns.items() if fill[p] < capacity}
    by_fill: dict[int, dict] = {}
    for p, n in open_.items():
        by_fill.setdefault(fill[p], {})[p] = n
    stuck: Counter = Counter()

    def add(p: tuple, n: int) -> None:
        if not p:
            return
        f = sum(p)
        if f == capacity:
            full[p] += n
        else:
            at = by_fill.setdefault(f, {})
            at[p] = at.get(p, 0) + n

    def take(p: tuple, n: int) -> None:
        f = sum(p)
        at = by_fill[f]
        at[p] -= n
        if not at[p]:
            del at[p]
            if not at:
                del by_fill[f]

    def step(low: tuple) -> bool:
        base = sum(low)
        held = Counter(low)
        sizes = sorted(held)
        twos = sorted({x + y: (x, y) for i, x in enumerate(sizes) for y in sizes[i:] if x != y or held[x] > 1}.items())
        for f in sorted(by_fill, reverse=True):
            gap = capacity - f
            if f < base:
                break
            for other in list(by_fill[f]):
                same = other == low
                have = min(by_fill[f][other] // 2, by_fill[base][low]) if same else min(by_fill[f][other], by_fill[base][low])
                if not have:
                    continue
                trade = None
                for x in sorted(set(low), reverse=True):
                    if x <= gap:  # move
                        trade = ((x,), ())
                        break
                    need = x - gap  # the other gives back at least this much
                    got = sorted(y for y in set(other) if need <= y < x)
                    pick = (got[0],) if got else None
                    two = sorted(set(other))
                    for i, y in enumerate(two):  # one for two
                        if y >= x:
                            break
                        k = bisect_left(two, need - y, i)
                        if k < len(two) and y + two[k] < x and (k != i or other.count(y) > 1):
                            if pick is None or y + two[k] < sum(pick):
                                pick = (y, two[k])
                    if pick is not None:
                        trade = ((x,), pick)
                        break
                if trade is None:
                    for y in sorted(set(other), reverse=True):  # two for one
                        k = bisect_left(twos, (y + gap + 1,)) - 1
                        if k >= 0 and twos[k][0] > y:
                            trade = (twos[k][1], (y,))
                            break
                if trade:
                    gone, back = trade
                    a, b = list(low), list(other)
                    for x in gone:
                        a.remove(x)
                        b.append(x)
                    for y in back:
                        b.remove(y)
                        a.append(y)
                    take(low, have)
                    take(other, have)
                    add(tuple(sorted(a, reverse=True)), have)
                    add(tuple(sorted(b, reverse=True)), have)
                    return True
        return False

    gained = True
    while gained:  # a step may free bins that were stuck before it
        gained = False
        for p, n in stuck.items():
            add(p, n)
        stuck.clear()
        while by_fill:
            f = min(by_fill)
            low = next(iter(by_fill[f]))
            if step(low):
                gained = True
            else:
                n = by_fill[f][low]
                take(low, n)
                stuck[low] += n
    return full + stuck


def places(patterns: Counter) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, runs of its pieces by rank: run i begins at rank first[i] and puts piece r in
    sequence seq[i] + (r - first[i]) at offset[i]."""
    runs: dict[int, list] = {}
    used: Counter = Counter()
    seq = 0
    for pattern, n in sorted(patterns.items(), reverse=True):
        offset = 0
        for size in pattern:
            runs.setdefault(size, []).append((used[size], seq, offset))
            used[size] += n
            offset += size
        seq += n
    return {size: tuple(np.array(x, np.int64) for x in zip(*r)) for size, r in runs.items()}


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """The pieces of all texts: ids, then ``end_id``; longer ones than ``capacity`` cut from the end on
    into whole pieces, so that only the first is shorter."""

    def cut(batches):
        enc = encoder(path)
        for batch in batches:
            trim()
            out: list[tuple] = []
            for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.append(enc.encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity
                cuts = [0, *range(first or capacity, len(ids) + 1, capacity)]
                out.extend((name, k, a, b - a, zlib.crc32(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
            cols = list(zip(*out)) or [[]] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECE)


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Pack all documents into as few sequences of at most ``capacity`` tokens as the search finds.

    docs: ``doc_id``, ``text`` and any others, which are not read. A null or empty text is its end id
    alone; null ids and repeated rows are packed like others; an empty table gives no row. Returns one
    row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Pieces are written once with their task and their rank in it. Counts of lengths by task give the
    histogram and the first rank of each task, so no length, however common, is sorted or gathered.
    """
    made = materialize(pieces(docs, capacity, end_id, path).withColumn("task", F.spark_partition_id()), "pieces")
    counts = made.groupBy("length", "task").count()
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    runs = places(improve(best_fit(histogram, capacity), capacity))
    shared = made.sparkSession.sparkContext.broadcast(runs)  # bounded by the patterns, not by the rows

    from pyspark.sql import Window as W

    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    firsts = counts.withColumn("first", F.coalesce(F.sum("count").over(before), F.lit(0)))

    def place(table: pa.Table, own: pa.Table) -> pa.Table:
        first = dict(zip(own.column("size").to_pylist(), own.column("first").to_pylist()))
        length = table.column("length").to_numpy()
        seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        sizes, at, n = np.unique(length[order], return_index=True, return_counts=True)
        for size, i, k in zip(sizes.tolist(), at, n):
            rank = first[size] + np.arange(k)
            begin, seqs, offs = shared.value[size]
            run = np.searchsorted(begin, rank, "right") - 1
            where = order[i : i + k]
            seq[where], off[where] = seqs[run] + rank - begin[run], offs[run]
        return table.drop_columns(["task"]).append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off))

    # other names than on the left: a column that both sides have from one table can be lost in a cogroup
    firsts = firsts.select(F.col("task").alias("own_task"), F.col("length").alias("size"), "first")
    by_task = made.groupBy("task").cogroup(firsts.groupBy("own_task"))
    return by_task.applyInArrow(place, PIECE + ", sequence_id long, offset long")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
