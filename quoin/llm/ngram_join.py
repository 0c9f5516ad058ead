"""N-gram Jaccard join by prefix trees.

A document is the set of its n-word shingles. All sets are ordered by one global order: shingles that
many documents of a batch share come last, by how often they were seen, all others first, by their hash.
Two sets that link share m shingles among the first n - ceil(t n) + m of each (their prefixes, m = 4 or
what a small set needs at least). Prefix entries meet by shingle; pairs that meet m times and whose sizes
allow a link are held against each other by small sketches, and those that these do not rule out go on to
prefix trees. A tree holds its sets sorted by the global order, so that neighbours
share their beginnings, and knows how long these are; it is built once and searched for any number of
queries. The overlap with a query is carried along a shared beginning and computed once, and a subtree is
pruned as soon as the overlap so far and the remaining lengths cannot reach what its smallest set needs.

Copies are one class. Classes that share a prefix shingle are first held against the least class of
that shingle; what this links are components, and only pairs of different components meet afterwards, so
a group of thousands of near-copies does not emit its pairs. The order only moves work: any order, and
any bound on the list of frequent shingles, gives the same links.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import (
    byte_runs,
    components,
    discard,
    materialize,
    mix,
    partitions,
    release,
    row_key,
    spread_join,
    table,
    text_buffers,
    trim,
    word_hashes,
)

U = np.uint64
TOP = U(1 << 63)
_MIX = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB)]


def shingle_sets(texts: pa.Array, n: int):
    """(row, sorted distinct 64-bit shingle hashes) of each text; with fewer than n words the whole
    sequence is one shingle, without words there is none."""
    data, offs = text_buffers(texts)
    for i, j in byte_runs(offs, 1 << 20):
        h, at = word_hashes(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        m = len(h) - n + 1
        if m > 0:
            grams = np.zeros(m, np.uint64)
            for k in range(n):
                grams = grams * U(0x9FB21C651E98DF25) + h[k : k + m] * _MIX[k % len(_MIX)]
            grams = mix(grams)
        for r in range(j - i):
            a, b = int(at[r]), int(at[r + 1])
            if b - a >= n:
                yield i + r, np.unique(grams[a : b - n + 1])
            elif b > a:
                one = np.array([b - a], np.uint64)
                for k in range(a, b):
                    one = mix(one * U(31) + h[k : k + 1] * _MIX[(k - a) % len(_MIX)])
                yield i + r, one
            else:
                yield i + r, np.zeros(0, np.uint64)


def ordered(keys: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Keys of the global order, ascending. ``frequent`` holds the sorted hashes of frequent shingles, each
    with its rank in its second row."""
    if frequent.shape[1]:
        k = np.searchsorted(frequent[0], keys)
        k[k == frequent.shape[1]] = 0
        is_freq = frequent[0][k] == keys
        keys = np.where(is_freq, TOP | frequent[1][k], keys >> U(1))
    else:
        keys = keys >> U(1)
    return np.unique(keys)


def need(size: int, percent: int) -> int:
    """The least overlap of a set of this size with any set it links to."""
    return -(-percent * size // 100)


MEET = 4  # prefix shingles that a pair must share; the prefixes are as much longer


def meetings(size: int, percent: int) -> int:
    return min(MEET, need(size, percent))


class PrefixTree:
    """Sets, each ascending in the global order, as a tree of their beginnings: sorted, with the number of
    keys that each shares with the one before it."""

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.sets = [sets[i] for i in self.order]
        self.shared = [0] * len(sets)
        for k, (a, b) in enumerate(zip(self.sets, self.sets[1:]), 1):
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            self.shared[k] = int(differ[0]) if len(differ) else m

    def links(self, query: np.ndarray, percent: int, among: list[bool] | None = None, step: int = 64) -> list[int]:
        """Indices of the sets (of those that ``among`` marks) that link with ``query``."""
        linked: list[int] = []
        gain = np.zeros(1, np.int64)  # overlap of the first d keys of the walked path with the query
        path = 0  # keys that the set at hand shares with the set walked last
        dead, dead_gain, dead_left = -1, 0, 0  # where the last walk ended without hope, with what overlap and rest
        nq = len(query)
        for i, s, shared in zip(self.order, self.sets, self.shared):
            path, n = min(path, shared), len(s)
            want = -(-percent * (nq + n) // (100 + percent))  # smallest integer o with 100 o >= percent (nq + n - o)
            if among is not None and not among[i] or want > min(nq, n):
                continue
            depth = min(path, len(gain) - 1)
            gain = gain[: depth + 1]
            on, path = path, n
            if 0 <= dead <= on and dead_gain + min(n - dead, dead_left) < want:
                continue  # it lies in a subtree without hope for it either
            dead = -1
            while depth < n:
                part = s[depth : depth + step]
                k = np.searchsorted(query, part)
                k[k == nq] = nq - 1
                gain = np.concatenate([gain, gain[-1] + np.cumsum(query[k] == part)])
                depth += len(part)
                # what is left of the query lies above the last key walked
                left = nq - int(np.searchsorted(query, s[depth - 1], "right"))
                if gain[-1] + min(n - depth, left) < want:
                    dead, dead_gain, dead_left = depth, int(gain[-1]), left
                    break
            else:
                if gain[n] >= want:
                    linked.append(i)
        return linked


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, frequent_from: int = 2, frequent_max: int = 500_000, hot_from: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links) and row_key per document.

    docs: ``doc_id``, ``text``; others are not read. Texts that are null, empty or without words have
    no shingles and link with nothing. Null ids link but never name a component, and have a null one
    only where all ids of the component are null. Rows that repeat an id and text are one document. An
    empty table gives no row. Shingles are known by 64-bit hashes and a class by the 64-bit hash of its set with its size.
    ``frequent_max`` bounds the list that is broadcast; it changes speed alone, as does ``hot_from``, the
    number of classes from which those of a shingle meet in tiles instead of pairs.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), F.col("text").cast("string").alias("text"))

    def signatures(batches):
        for batch in batches:
            trim()
            keys, n_sh, cls = batch.column("row_key").to_numpy(), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.uint64)
            seen, parts = set(), []
            for r, s in shingle_sets(batch.column("text"), n):
                n_sh[r] = len(s)
                if len(s):
                    cls[r] = _class(s)
                    if int(cls[r]) not in seen:
                        seen.add(int(cls[r]))
                        parts.append(s)
            grams, counts = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint64), return_counts=True)
            often = counts >= frequent_from
            grams, counts = grams[often], counts[often]
            m = len(grams)
            none = pa.nulls(m, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([batch.column("doc_id"), none]), pa.concat_arrays([pa.array(keys), none]), pa.array(np.concatenate([n_sh, counts])),
                    pa.array(np.concatenate([cls.view(np.int64), grams.view(np.int64)])), pa.array(np.arange(len(n_sh) + m) >= len(n_sh)),
                ],
                ["doc_id", "row_key", "n", "cls", "gram"],
            )

    sigs = materialize(rows.mapInArrow(signatures, "doc_id long, row_key long, n long, cls long, gram boolean"), "sigs")
    often = sigs.where("gram").groupBy("cls").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "cls").limit(frequent_max).toArrow()
    gram, count = often.column("cls").to_numpy().view(np.uint64), often.column("n").to_numpy()
    rank = np.empty(len(gram), np.uint64)
    rank[np.lexsort((gram, count))] = np.arange(len(gram), dtype=np.uint64)
    by_gram = np.argsort(gram)
    frequent = spark.sparkContext.broadcast(np.stack([gram[by_gram], rank[by_gram]]))
    sigs = sigs.where("not gram").drop("gram")

    # prefix entries meet by shingle, packed by bucket
    n_buckets = max(8, partitions(spark))

    def prefixes(batches):
        for batch in batches:
            trim()
            keys, cls, size, seen = [], [], [], set()
            for _, s in shingle_sets(batch.column("text"), n):
                if not len(s) or (c := int(_class(s))) in seen:
                    continue
                seen.add(c)
                own = ordered(s, frequent.value)[: len(s) - need(len(s), percent) + meetings(len(s), percent)]
                keys.append(own)
                cls.append(np.full(len(own), c, np.uint64))
                size.append(np.full(len(own), len(s), np.uint32))
            if not keys:
                continue
            keys, cls, size = map(np.concatenate, (keys, cls, size))
            bucket = (mix(keys) % U(n_buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
            out = [(b, order[i:j]) for b, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i]
            yield pa.RecordBatch.from_pydict({"bucket": [b for b, _ in out]} | {name: [x[o].tobytes() for _, o in out] for name, x in (("keys", keys), ("cls", cls), ("size", size))})

    packed = rows.select("text").mapInArrow(prefixes, "bucket long, keys binary, cls binary, size binary")

    def meet(table: pa.Table) -> pa.Table:
        """Entries whose shingle another class has too, in order; a row holds all entries of its shingles."""
        keys, cls, size = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in ENTRY)
        order = np.lexsort((cls, keys))
        keys, cls, size = keys[order], cls[order], size[order]
        fresh = np.ones(len(keys), bool)
        fresh[1:] = (keys[1:] != keys[:-1]) | (cls[1:] != cls[:-1])
        keys, cls, size = keys[fresh], cls[fresh], size[fresh]
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        n_of = np.diff(np.append(at, len(keys)))
        on = np.repeat(n_of, n_of) > 1
        keys, cls, size = keys[on], cls[on], size[on]
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        cuts = np.searchsorted(at, np.arange(0, len(keys), ENTRIES))
        cuts = [*np.unique(at[cuts[cuts < len(at)]]).tolist(), len(keys)]
        return pa.table({name: pa.array([x[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary()) for name, x in (("keys", keys), ("cls", cls), ("size", size))})

    met = materialize(packed.groupBy("bucket").applyInArrow(meet, "keys binary, cls binary, size binary"), "met")
    release(spark)
    classes = sigs.where("n > 0").groupBy("cls").agg(F.min("row_key").alias("row_key"), F.min("doc_id").alias("least_id"), F.count("*").alias("copies"))
    classes = materialize(classes, "classes")

    def sets_for(wanted: DataFrame, form=lambda s: ordered(s, frequent.value).tobytes(), tag: str = "sets") -> DataFrame:
        """The sets of classes, one for each, made from one document of each and written as ``form`` says."""

        def sets_of(batches):
            seen = set()  # of copies in a partition one is enough
            for batch in batches:
                trim()
                found = {int(_class(s).view(np.int64)): s for _, s in shingle_sets(batch.column("text"), n)}
                found = {c: form(s) for c, s in found.items() if c not in seen}
                seen |= found.keys()
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], ["cls", "keys"])

        keys = materialize(classes.join(wanted.distinct(), "cls", "left_semi").select("row_key"), "wanted")
        # up to 8 MB of keys go to the texts, more meet them in a shuffle
        n_keys = keys.count()
        few = _few(keys, n_keys)
        made = rows.join(few, "row_key", "left_semi").select("text").mapInArrow(sets_of, "cls long, keys binary")
        if sigs.join(few, "row_key", "left_semi").count() > n_keys:  # rows that repeat an id and text
            made = made.dropDuplicates(["cls"])
        made = materialize(made, tag)
        discard(keys)
        return made

    def sketches_for(wanted: DataFrame) -> DataFrame:
        return sets_for(wanted, _sketch, "sketches")

    def linking(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (q, m) that link: the sets of their classes go into trees."""
        return materialize(verify(pairs, sets, percent), "linked")

    def often_enough(pairs: DataFrame) -> DataFrame:
        """Pairs (q, m, weight) that meet as often as the smaller needs."""
        return pairs.groupBy("q", "m").agg(F.sum("weight").alias("weight")).where(F.col("weight") >= ENOUGH).select("q", "m")

    in_pairs = lambda p: p.select(F.col("q").alias("cls")).unionByName(p.select(F.col("m").alias("cls")))

    def with_least(batches):
        """Each class of a shingle with its least class."""
        for batch in batches:
            for cls, size, at, n_of in _shingles(batch):
                least = np.repeat(at, n_of)
                yield _weighed(cls, size, least, np.arange(len(cls)), percent)

    stars = materialize(often_enough(met.mapInArrow(with_least, PAIR)), "stars")
    sketches = sketches_for(in_pairs(stars))
    first = materialize(likely(stars, sketches, percent), "likely")
    discard(stars)
    release(spark)
    sets = sets_for(in_pairs(first))
    linked = linking(first, sets)
    comps = components(linked.select(F.col("q").alias("a"), F.col("m").alias("b")))
    release(spark)

    # Pairs of different components that meet. Shingles with many classes make no pairs: their classes are
    # clusters, held against each other in tiles of blocks. A pair with such a shingle is in one cluster.
    # Components that are not known here only let more pairs meet.
    held = comps.limit(COMPONENTS).toArrow()
    node, root = (held.column(c).to_numpy() for c in ("node", "root"))
    by_node = np.argsort(node)
    known = spark.sparkContext.broadcast(np.stack([node[by_node], root[by_node]]))

    def mixed(batch):
        """Shingles whose classes are of several components."""
        for cls, size, at, n_of in _shingles(batch):
            comp = _looked_up(cls, known.value)
            yield cls, size, comp, at, n_of, np.minimum.reduceat(comp, at) != np.maximum.reduceat(comp, at)

    def hot_classes(batches):
        for batch in batches:
            for cls, _, comp, at, n_of, on in mixed(batch):
                of = np.repeat(on & (n_of > hot_from), n_of)
                yield pa.RecordBatch.from_arrays([pa.array(x[of]) for x in (cls, comp, cls[np.repeat(at, n_of)])], ["cls", "comp", "least"])

    def cold_pairs(batches):
        for batch in batches:
            for cls, size, comp, at, n_of, on in mixed(batch):
                # how many classes of its shingle come after an entry
                after = np.repeat(np.where(on & (n_of <= hot_from), at + n_of, 0), n_of) - np.arange(len(cls)) - 1
                for step in range(1, int(after.max()) + 1):
                    a = np.flatnonzero(after >= step)
                    a = a[comp[a] != comp[a + step]]
                    yield _weighed(cls, size, a, a + step, percent)

    hot = materialize(met.mapInArrow(hot_classes, "cls long, comp long, least long").distinct(), "hot")
    pairs = materialize(often_enough(met.mapInArrow(cold_pairs, PAIR)), "pairs")
    discard(met, first)
    release(spark)
    cluster = components(hot.select(F.col("cls").alias("a"), F.col("least").alias("b")))
    members = hot.select("cls", "comp").distinct().join(cluster.select(F.col("node").alias("cls"), F.col("root").alias("cluster")), "cls")
    members = materialize(members, "members")
    discard(hot)
    met = pairs
    sketches = sketches.unionByName(sketches_for(in_pairs(met).distinct().join(sketches.select("cls"), "cls", "left_anti")))
    pairs = materialize(likely(met, sketches, percent), "likely")
    discard(met)
    missing = in_pairs(pairs).unionByName(members.select("cls")).distinct().join(sets.select("cls"), "cls", "left_anti")
    sets = sets.unionByName(sets_for(missing))
    more = linking(pairs, sets)
    release(spark)
    within = materialize(verify_clusters(members, sets, percent), "linked")
    discard(pairs, members)
    comps = components(linked.unionByName(more).unionByName(within).select(F.col("q").alias("a"), F.col("m").alias("b")))

    # components are named on classes; a component of many classes and a class of many copies fill no task
    rooted = classes.join(comps.withColumnRenamed("node", "cls"), "cls", "left").select("cls", F.coalesce("root", "cls").alias("root"), "least_id")
    roots = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("n"))
    rooted, roots = materialize(rooted, "rooted"), materialize(roots, "roots")
    named = spread_join(rooted.select("cls", "root"), roots.drop("n"), "root", roots.select("root", "n"))
    named = materialize(named.select("cls", "component_id"), "named")
    out = spread_join(sigs.where("n > 0"), named, "cls", classes.select("cls", F.col("copies").alias("n")))
    out = out.unionByName(sigs.where("n = 0").withColumn("component_id", F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "row_key")


#: An entry of the index, entries of a row, nodes whose component is sent along (32 MB), rows that are broadcast
ENTRY = (("keys", U), ("cls", np.int64), ("size", np.uint32))
ENTRIES, COMPONENTS, FEW = 1 << 18, 2_000_000, 1_000_000
PAIR = "q long, m long, weight long"
ENOUGH = math.lcm(*range(1, MEET + 1))


def _few(df: DataFrame, n: int) -> DataFrame:
    """``df``, sent to the other side of a join where its ``n`` rows are few: what it meets stays in place."""
    return F.broadcast(df) if n <= FEW else df


def _shingles(batch: pa.RecordBatch):
    """Of each row of the index: classes and sizes, and where each shingle's begin and how many they are."""
    for r in range(batch.num_rows):
        keys, cls, size = (np.frombuffer(batch.column(c)[r].as_buffer(), t) for c, t in ENTRY)
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        yield cls, size, at, np.diff(np.append(at, len(keys)))


def _looked_up(cls: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The component of each class, itself where it is in none."""
    if not known.shape[1]:
        return cls
    k = np.searchsorted(known[0], cls)
    k[k == known.shape[1]] = 0
    return np.where(known[0][k] == cls, known[1][k], cls)


def _weighed(cls: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> pa.RecordBatch:
    """Pairs of the entries a and b whose sizes allow a link. The weights of as many as the smaller one needs
    sum up to ``ENOUGH``."""
    low, high = np.minimum(size[a], size[b]).astype(np.int64), np.maximum(size[a], size[b]).astype(np.int64)
    on = (cls[a] != cls[b]) & (low * 100 >= high * percent)
    a, b = a[on], b[on]
    weight = ENOUGH // np.minimum(MEET, -(-percent * low[on] // 100))
    return pa.RecordBatch.from_arrays([pa.array(cls[a]), pa.array(cls[b]), pa.array(weight)], ["q", "m", "weight"])


def _class(s: np.ndarray) -> np.uint64:
    """The hash of a set, of its sorted shingles and their number."""
    h = np.bitwise_xor.reduce(mix(s * _MIX[0] + U(1)), keepdims=True) * _MIX[1] + np.add.reduce(mix(s ^ _MIX[2]), keepdims=True)
    return mix(h + np.array([len(s)], np.uint64) * _MIX[3])[0]


def _sketch(s: np.ndarray) -> bytes:
    """How many keys fall in each of ``SPREAD`` buckets, a byte each; empty where a byte does not hold it."""
    counts = _spread([s])[0]
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def likely(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (q, m) whose sketches allow a link: the sum of smaller counts bounds an overlap from above. Sets,
    which are many times as large, are sent only for these. A pair without one of its sketches stays."""
    side = lambda c: sketches.select(F.col("cls").alias(c), F.col("keys").alias(f"_{c}"))
    both = pairs.join(side("q"), "q").join(side("m"), "m").select("q", "m", "_q", "_m")

    def run(batches):
        for batch in batches:
            known = np.array([len(a) == len(b) == SPREAD for a, b in zip(*[batch.column(c).to_pylist() for c in ("_q", "_m")])], bool)
            on, has = ~known, pa.array(known)
            a, b = (np.frombuffer(b"".join(batch.column(c).filter(has).to_pylist()), np.uint8).reshape(-1, SPREAD) for c in ("_q", "_m"))
            total = a.sum(1, dtype=np.int64) + b.sum(1, dtype=np.int64)
            on[known] = np.minimum(a, b).sum(1, dtype=np.int64) * (100 + percent) >= percent * total
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(on)) for c in ("q", "m")], ["q", "m"])

    return both.mapInArrow(run, "q long, m long")


def verify(pairs: DataFrame, sets: DataFrame, percent: int, chunk: int = 128) -> DataFrame:
    """The pairs (q, m) that link. A query's set goes once to each chunk of at most about ``chunk`` sets
    it is held against."""
    spark = pairs.sparkSession
    sized = pairs.groupBy("q").count().select("q", F.greatest(F.ceil(F.col("count") / chunk), F.lit(1)).cast("int").alias("chunks"))
    split = F.pmod(F.xxhash64("m"), F.col("chunks").cast("long"))
    n = pairs.count()
    members = _few(pairs.join(sized, "q").select("q", split.alias("part"), "m"), n)
    members = members.join(sets.withColumnRenamed("cls", "m"), "m").select("q", "part", "m", "keys")
    heads = _few(sized, n).join(sets.withColumnRenamed("cls", "q"), "q").select("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks").cast("long") - 1)).alias("part"), F.lit(None).cast("long").alias("m"), "keys")
    both = members.unionByName(heads).repartition(partitions(spark), "q", "part").sortWithinPartitions("q", "part", "m")

    def run(batches):
        """Groups arrive whole and in order, the query first."""
        group, query, names, held = None, None, [], []

        def close():
            if names:
                on = PrefixTree(held).links(query, percent)
                return pa.RecordBatch.from_pydict({"q": pa.array([group[0]] * len(on), pa.int64()), "m": pa.array([names[i] for i in on], pa.int64())})
            return None

        for batch in batches:
            for q, part, m, keys in zip(batch.column("q").to_pylist(), batch.column("part").to_pylist(), batch.column("m").to_pylist(), batch.column("keys")):
                if (q, part) != group:
                    if (out := close()) is not None:
                        yield out
                    group, names, held = (q, part), [], []
                keys = np.frombuffer(keys.as_py(), np.uint64)
                if m is None:
                    query = keys
                else:
                    names.append(m)
                    held.append(keys)
        if (out := close()) is not None:
            yield out

    return both.mapInArrow(run, "q long, m long")


def verify_clusters(members: DataFrame, sets: DataFrame, percent: int, block_rows: int = 256) -> DataFrame:
    """Links (q, m) that join the components within each cluster. members: cls, comp, cluster.

    A cluster is cut into blocks of about ``block_rows`` sets (of up to 16 times as many where it has more than 64
    blocks, as each block is sent to as many tiles), and each pair of blocks is a tile: one
    block's sets are the trees, the other's the queries. Sets whose components are already joined, or were
    joined earlier in the tile, are not compared, so a tile returns at most a forest of its sets.
    """
    spark = members.sparkSession
    least, most = F.ceil(F.count("*") / block_rows), F.ceil(F.count("*") / (16 * block_rows))
    sized = members.groupBy("cluster").agg(F.least(least, F.greatest(F.lit(64), most)).alias("blocks"))
    placed = members.join(sized, "cluster").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")))
    placed = _few(placed, members.count()).join(sets, "cls").select("cluster", "block", "cls", "comp", "keys")

    def packed(table: pa.Table) -> pa.Table:
        keys = table.column("keys").to_pylist()
        numbers = {c: [table.column(c).to_numpy().tobytes()] for c in ("cls", "comp")}
        lengths = [np.array([len(k) for k in keys], np.int64).tobytes()]
        return pa.table({"cluster": [table.column("cluster")[0].as_py()], "block": [table.column("block")[0].as_py()], **numbers, "lengths": lengths, "keys": [b"".join(keys)]})

    blocks = materialize(placed.groupBy("cluster", "block").applyInArrow(packed, "cluster long, block long, cls binary, comp binary, lengths binary, keys binary"), "blocks")
    side = lambda s: blocks.select("cluster", *[F.col(c).alias(c + s) for c in ("block", "cls", "comp", "lengths", "keys")])
    names = blocks.select("cluster", F.col("block").alias("block_a"))
    tiles = names.join(names.withColumnRenamed("block_a", "block_b"), "cluster").where("block_a <= block_b")
    tiles = tiles.repartition(partitions(spark), "cluster", "block_a", "block_b")
    work = tiles.join(side("_a"), ["cluster", "block_a"]).join(side("_b"), ["cluster", "block_b"])

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                own = [_unpacked(*[batch.column(c + s)[r].as_py() for c in ("cls", "comp", "lengths", "keys")]) for s in ("_a", "_b")]
                links = _tile(own[0], own[1], batch.column("block_a")[r] == batch.column("block_b")[r], percent)
                if links:
                    yield pa.RecordBatch.from_pydict({"q": pa.array([q for q, _ in links], pa.int64()), "m": pa.array([m for _, m in links], pa.int64())})

    return work.mapInArrow(run, "q long, m long")


def _unpacked(cls: bytes, comp: bytes, lengths: bytes, keys: bytes):
    ends = np.cumsum(np.frombuffer(lengths, np.int64)) // 8
    return np.frombuffer(cls, np.int64), np.frombuffer(comp, np.int64), np.split(np.frombuffer(keys, np.uint64), ends[:-1])


SPREAD = 256


def _spread(sets: list[np.ndarray]) -> np.ndarray:
    """How many keys of each set fall in each of ``SPREAD`` buckets."""
    return np.stack([np.bincount((mix(s) % U(SPREAD)).astype(np.int64), minlength=SPREAD) for s in sets]).astype(np.int32)


def _tile(a, b, same: bool, percent: int) -> list[tuple[int, int]]:
    """A forest of links between the components of two blocks. Sets whose buckets cannot share enough keys (the
    sum of the smaller counts bounds the overlap from above) are left out of a query's walk."""
    (cls_a, comp_a, sets_a), (cls_b, comp_b, sets_b) = a, b
    comp_a, comp_b = comp_a.copy(), comp_b.copy()
    spread_a, spread_b = _spread(sets_a), _spread(sets_b)
    size_b = np.array([len(s) for s in sets_b])
    tree, out = PrefixTree(sets_b), []
    for i, query in enumerate(sets_a):
        among = (comp_b != comp_a[i]) & (np.arange(len(sets_b)) > (i if same else -1))
        if not among.any():
            continue
        want = -(-percent * (len(query) + size_b) // (100 + percent))
        among &= np.minimum(spread_b, spread_a[i]).sum(1) >= want
        if not among.any():
            continue
        for j in tree.links(query, percent, among.tolist()):
            x, y = comp_a[i], comp_b[j]
            if x != y:
                low, high = min(x, y), max(x, y)
                comp_a[comp_a == high] = low
                comp_b[comp_b == high] = low
                out.append((int(cls_a[i]), int(cls_b[j])))
    return out


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), n=4, percent=85).drop("row_key")
