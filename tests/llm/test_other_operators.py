import random
from pathlib import Path

import numpy as np
import pytest
import zstandard

from quoin.llm import vectors, warc
from quoin.llm.common import shared_dir


def brute_vectors(rows):
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    n, up, links = len(rows), list(range(len(rows))), [0] * len(rows)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(n):
        for j in range(i):
            if good[i] and good[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b >= 0.9 * np.linalg.norm(a) * np.linalg.norm(b):
                    links[i] += 1
                    links[j] += 1
                    up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, links[i], least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("held", [300, 64 << 20])
def test_embedding_near_dedup(spark, held):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + rng.normal(size=16) * rng.choice([0.05, 0.2, 0.35])).tolist()) for i in range(150)]
    x = [1.0, 2.0, 3.0]
    rows += [(1000, x), (1001, x), (1001, x), (None, x), (1002, None), (1003, [0.0] * 3), (1004, [1.0, None, 2.0]), (1005, [float("nan"), 1.0, 1.0]), (1006, [1e-300, 2e-300, 3e-300]), (1007, [1e300, 2e300, 3e300]), (1008, [1.0, 2.0]), (1009, []), (1010, [-0.0, 0.0, 0.0]), (1011, [float("inf"), 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, label int, cls int")
    got = vectors.near_duplicates(df, block_rows=32, held_bytes=held).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == brute_vectors(rows)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    assert not vectors.near_duplicates(df.limit(0)).count()


def test_many_copies_of_a_vector(spark):
    rows = [(i, [1.0, 2.0, 0.5]) for i in range(5000, 0, -1)] + [(0, [1.0, 2.0, 0.6]), (9000, [-1.0, 0.0, 0.0])]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3))
    assert {tuple(r) for r in got.groupBy("n_links", "component_id").count().collect()} == {(5000, 0, 5001), (0, 9000, 1)}


def test_products_are_exact_over_many_dimensions():
    rng = np.random.default_rng(4)
    a, b = (rng.integers(100, 128, (7, 5000)).astype(np.int8) for _ in range(2))
    assert (vectors.products(a, b) == a.astype(np.int64) @ b.astype(np.int64).T).all()


def test_quantisation_bounds_hold():
    rng = np.random.default_rng(1)
    x, y = (vectors.unit_rows(rng.normal(size=(200, 24)) * 10.0 ** rng.integers(-3, 3, (200, 1))) for _ in range(2))
    (a, s, n, e), (b, t, m, f) = vectors.quantise(x), vectors.quantise(y)
    near = (a.astype(float) @ b.astype(float).T) * s[:, None] * t
    assert (np.abs(near - x @ y.T) <= e[:, None] * (m + f) + n[:, None] * f + vectors.SLACK).all()


PAGES = [(5, "http://a/", "x" * 200), (3, None, "x" * 200), (9, "http://b/\r\nX: 1", "é日" * 60), (8, "u", "é日" * 60), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""), (None, "u", "x" * 200), (7, "u", "WARC/1.1\r\n\r\n" * 20), (7, "u", "WARC/1.1\r\n\r\n" * 20), (10, "u", "y" * 300_000)]


@pytest.fixture(scope="module")
def manifest(spark):
    pages = spark.createDataFrame([(*p, "d", 1) for p in PAGES], "page_id long, url string, html string, digest string, size int")
    return warc.write_bundles(pages, f"{shared_dir(spark)}/test-warc", frame_bytes=500, bundle_bytes=2000)


def test_bundles_round_trip(manifest):
    import hashlib

    want = []
    for page, _, html in PAGES:
        raw = (html or "").encode()
        owner = min((p for p, _, h in PAGES if h == html and p is not None), default=None) if len(raw) >= 100 else None
        revisit = owner is not None and page != owner
        want.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", owner if revisit else None))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_bundles(manifest).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_bundles_are_seekable_and_plain(manifest):
    for row in manifest.collect():
        bundle = warc.BundleReader(row.uri)
        assert len(bundle.index) == row.n_records
        for name in random.Random(0).sample(list(bundle.where), len(bundle.where)):
            assert warc.parse(bundle.get(name))["warc-record-id"] == name
        plain = zstandard.ZstdDecompressor().stream_reader(Path(row.uri.removeprefix("file://")).open("rb"), read_across_frames=True).read()
        assert plain == b"".join(bundle)


def test_no_pages(spark, manifest):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert not warc.read_bundles(warc.write_bundles(empty, f"{shared_dir(spark)}/none-warc")).count()
