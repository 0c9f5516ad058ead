"""A quality classifier on supervised subword embeddings.

Words and character n-grams are hashed to vectors; a document is the average of the vectors of all its
words and n-grams; a softmax layer gives the class. Vectors and layer are trained together by stochastic
gradient descent in numpy, on a bounded sample of labelled rows. As the layer is linear in the average,
each vector is folded with it into one number for scoring, so a pass over the corpus is one table
look-up for each feature.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_runs, materialize, table, text_buffers, trim, word_hashes

GRAMS = (3, 4, 5)
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[0x09:0x0E] = 0x20


@dataclass(frozen=True)
class Settings:
    """``per_class`` labelled rows of each class at most are learned from (the bound on what is
    collected); ``buckets`` vectors of ``dim`` numbers for words and as many for n-grams."""

    per_class: int = 2000
    buckets: int = 1 << 16
    dim: int = 8
    epochs: int = 6
    steps: int = 1500  # at least so many batches, however few the rows
    rate: float = 40.0
    batch: int = 16
    seed: int = 7


def features(texts: pa.Array, buckets: int):
    """(ids, document starts) of all features of each run of documents: words first, then n-grams.
    Yields for each run (i, j) the ids and, for each feature kind, the offsets of documents in them."""
    data, offs = text_buffers(texts)
    for i, j in byte_runs(offs, 1 << 20):
        d, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        h, at = word_hashes(d, o, lower=False)
        kinds = [((h % np.uint64(buckets)).astype(np.int64), at)]
        # a space before the first and after the last byte of each document
        n = j - i
        padded = np.full(len(d) + n + 1, 0x20, np.uint32)
        padded[np.arange(len(d)) + 1 + np.repeat(np.arange(n), np.diff(o))] = _FOLD[d]
        starts = o + np.arange(n + 1)
        inner = padded != 0x20
        code, ok = padded * np.uint32(0x01000193), None
        for k in range(1, max(GRAMS)):
            m = len(padded) - k
            code = (code[:m] + padded[k : k + m]) * np.uint32(0x01000193)
            code ^= code >> np.uint32(15)
            if k > 1:
                ok = inner[1 : 1 + m] if ok is None else ok[:m] & inner[k - 1 : k - 1 + m]
            if k + 1 in GRAMS:
                where = np.flatnonzero(ok)
                kinds.append(((code[where] % np.uint32(buckets)).astype(np.int64) + buckets, np.searchsorted(where, starts)))
        yield i, j, kinds


def bags(texts: pa.Array, buckets: int) -> tuple[list[bytes], list[bytes]]:
    """Distinct features (int32) of each text, and their shares of it (float32): at most 2 x ``buckets``
    entries, however long the text."""
    ids_of, share_of = [], []
    for i, j, kinds in features(texts, buckets):
        for k in range(j - i):
            ids = np.concatenate([x[at[k] : at[k + 1]] for x, at in kinds])
            uniq, n = np.unique(ids, return_counts=True)
            ids_of.append(uniq.astype(np.int32).tobytes())
            share_of.append((n / max(1, len(ids))).astype(np.float32).tobytes())
    return ids_of, share_of


def train(ids_of: list[bytes], share_of: list[bytes], labels: np.ndarray, s: Settings) -> tuple[np.ndarray, float]:
    """One number for each feature and a bias: the log-odds of class 1 are their average plus the bias."""
    rng = np.random.default_rng(s.seed)
    vectors = rng.uniform(-1 / s.dim, 1 / s.dim, (2 * s.buckets, s.dim)).astype(np.float32).T.copy()  # a row for each dimension
    layer, bias = np.zeros((s.dim, 2), np.float32), np.zeros(2, np.float32)
    per_epoch = -(-len(ids_of) // s.batch)
    epochs = max(s.epochs, -(-s.steps // per_epoch))
    steps, done = epochs * per_epoch, 0
    for _ in range(epochs):
        order = rng.permutation(len(ids_of))
        for b in range(0, len(order), s.batch):
            pick = order[b : b + s.batch]
            ids = np.frombuffer(b"".join(ids_of[k] for k in pick), np.int32)
            weight = np.frombuffer(b"".join(share_of[k] for k in pick), np.float32)
            doc = np.repeat(np.arange(len(pick)), [len(ids_of[k]) // 4 for k in pick])
            mean = np.stack([np.bincount(doc, row[ids] * weight, len(pick)) for row in vectors], 1).astype(np.float32)
            z = mean @ layer + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), labels[pick]] -= 1
            rate = s.rate * (1 - done / steps) / len(pick)
            back = -rate * (p @ layer.T)
            layer -= rate * 0.1 * mean.T @ p
            bias -= rate * 0.02 * p.sum(0)
            for row, step in zip(vectors, back.T):
                np.add.at(row, ids, step[doc] * weight)
            done += 1
    odds = layer[:, 1] - layer[:, 0]
    return (odds @ vectors).astype(np.float64), float(bias[1] - bias[0])


def sample(docs: DataFrame, labels: DataFrame, s: Settings) -> DataFrame:
    """doc_id, quality, text: at most ``per_class`` texts of each class, those with the smallest hashes of
    their ids, whole. Held-out rows (crc32 of the id mod 4 = 2) and rows without a label of 0 or 1 are never
    taken; a document with several labels counts by the smallest."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where("quality in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")
    pick = None
    for c in (0, 1):
        some = known.where(F.col("quality") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.per_class)
        pick = some if pick is None else pick.unionByName(some)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return text.join(F.broadcast(pick), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, s: Settings) -> tuple[np.ndarray, float] | None:
    """The folded weights and the bias, or None without labelled rows. Bags are made where the texts are;
    one task, not the driver, trains on the at most 2 x ``per_class`` bags."""

    def to_bags(batches):
        for batch in batches:
            ids, shares = bags(batch.column("text"), s.buckets)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(ids, pa.binary()), pa.array(shares, pa.binary())], ["doc_id", "quality", "ids", "shares"])

    def learn(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        rows = pa.Table.from_batches(parts).sort_by("doc_id")
        weights, bias = train(rows.column("ids").to_pylist(), rows.column("shares").to_pylist(), rows.column("quality").to_numpy().astype(np.int64), s)
        del rows, parts
        trim()
        yield pa.RecordBatch.from_pydict({"weights": [weights.tobytes()], "bias": [bias]})

    made = sample(docs, labels, s).mapInArrow(to_bags, "doc_id long, quality int, ids binary, shares binary")
    model = materialize(made.repartition(1).mapInArrow(learn, "weights binary, bias double"), "model").first()
    return model and (np.frombuffer(model["weights"], np.float64), model["bias"])


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), cutoff: float = 0.7, keep: tuple[str, ...] = ()) -> DataFrame:
    """Score every whole text: doc_id, held_out, score, predicted, learned, and the columns of ``docs`` that
    ``keep`` names.

    docs: ``doc_id``, ``text``; labels: ``doc_id``, ``quality``; other columns are not read. Null and
    empty texts have no features and score by the bias alone; null ids are scored and not held out;
    repeated rows score alike; without labelled rows every score is 0.5 and ``learned`` is false; an empty
    table gives no row. The folded table (2 x ``buckets`` numbers) is all that the driver holds.
    """
    model = fit(docs, labels, s)
    shared = docs.sparkSession.sparkContext.broadcast(model or (np.zeros(2 * s.buckets), 0.0))
    others = [c for c in keep if c not in ("doc_id", "text")]
    passed = ["doc_id", "held_out", *others, *["text"] * ("text" in keep)]

    def run(batches):
        weights, bias = shared.value
        for batch in batches:
            trim()
            out = np.empty(batch.num_rows)
            for i, j, kinds in features(batch.column("text"), s.buckets):
                total, n = np.zeros(j - i), np.zeros(j - i)
                for ids, at in kinds:
                    sums = np.concatenate([[0.0], np.cumsum(weights[ids])])
                    total += sums[at[1:]] - sums[at[:-1]]
                    n += np.diff(at)
                out[i:j] = 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + bias, -40, 40)))
            yield pa.RecordBatch.from_arrays([*map(batch.column, passed), pa.array(out)], [*passed, "score"])

    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    rows = docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), *others, text.alias("text"))
    scored = rows.mapInArrow(run, rows.select(*passed, F.lit(0.0).alias("score")).schema)
    return scored.withColumns({"predicted": (F.col("score") >= cutoff).cast("int"), "learned": F.lit(model is not None)})


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
