"""Each stage of the pipeline against a brute-force version, on what the stage before it kept."""

import random

import numpy as np

import corpus_pipeline
from quoin.llm import bpe, classifier, rules
from quoin.llm.common import materialize

RNG = random.Random(21)
GOOD = ["market", "season", "harbour", "village", "teacher", "bridge", "winter", "garden"]


def text(n):
    return " ".join(RNG.choice(GOOD) + str(RNG.randint(0, 9999)) for _ in range(n))


def write(spark, tmp_path):
    shared = text(60)
    base = [text(80) + " " + shared for _ in range(20)] + [text(70) for _ in range(20)]
    near = [base[0] + " more", base[0], base[21] + " end words"]
    bad = [" ".join(RNG.choice(["BUY!!", "click$$", "WIN!!!"]) + str(RNG.randint(0, 99)) for _ in range(70)) for _ in range(40)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate([*base, *near, *bad, "short text", "", None])]
    rows.append((None, text(60), "en", None, None))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i < 43), 0) for i in range(83) if i % 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def shingles(t, n=5):
    w = t.split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)}


def test_stages(spark, tmp_path):
    sf = write(spark, tmp_path)
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = materialize(stages["quality_classifier"](spark, docs, sf), "t")
    want = {r.doc_id for r in classifier.score(docs, labels).where("score >= 0.7").collect()}
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == list(corpus_pipeline.COLUMNS)
    assert len(want & set(range(43))) >= 40 and len(want & set(range(43, 83))) <= 3

    ruled = materialize(stages["quality_rules"](spark, kept, sf), "t")
    assert {r.doc_id for r in ruled.collect()} == {r.doc_id for r in rules.judge(kept, labels).where("kept").collect()}
    assert all(len((r.text or "").split()) >= 50 for r in ruled.collect())

    joined = materialize(stages["ngram_jaccard"](spark, ruled, sf), "t")
    rows = sorted((r.doc_id, shingles(r.text)) for r in ruled.collect() if r.doc_id is not None)
    root = {d: d for d, _ in rows}
    for d, a in rows:
        for e, b in rows:
            if e < d and 100 * len(a & b) >= 80 * len(a | b):
                old, new = max(root[d], root[e]), min(root[d], root[e])
                root = {k: new if v == old else v for k, v in root.items()}
    assert {r.doc_id for r in joined.collect() if r.doc_id is not None} == {d for d, r in root.items() if d == r}

    cut = materialize(stages["suffix_dedup"](spark, joined, sf), "t")
    before = sorted((r.doc_id, r.text.encode()) for r in joined.collect() if r.doc_id is not None)
    first = {}
    for d, t in before:
        for p in range(len(t) - 49):
            first.setdefault(t[p : p + 50], d)
    for d, t in before:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 49):
            gone[p : p + 50] |= first[t[p : p + 50]] < d
        left = bytes(np.frombuffer(t, np.uint8)[~gone]).decode()
        assert [(r.text, r.n_chars) for r in cut.where(f"doc_id = {d}").collect()] == ([(left, len(left))] if left else [])

    packed = stages["best_fit_packing"](spark, cut, sf).toPandas()
    total = sum(len(bpe.encoder().encode(r.text)) + 1 for r in cut.collect())
    sums = packed.groupby("sequence_id").length.sum()
    assert packed.length.sum() == total and sums.max() <= 1024 and len(sums) <= -(-total // 1024) + 1
