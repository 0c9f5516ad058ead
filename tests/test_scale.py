"""What keeps work in proportion to the input: partitions, exchanges, bands and batches, with the same results."""

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from tests.test_oracles import DIR

from quoin.functions import text
from quoin.operators import matching, pipelines, raster, scaling, spatial, synthesis
from quoin.plans import boxes, catalog, ordered
from quoin.plans.fixtures import Tables


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_images_are_spread_and_lines_need_no_other_exchange(spark):
    t = Tables(spark, DIR)
    many = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert ordered._images(t).rdd.getNumPartitions() == ordered._pixels(t).rdd.getNumPartitions() == many
    assert len(re.findall(r"Exchange", plan(raster.line_runs(ordered._pixels(t))))) == 2  # the parts, once for each direction


def test_rooms_of_equal_and_other_images(spark, monkeypatch):
    monkeypatch.setattr(raster, "REMEMBERED", 30_000)
    rng = np.random.default_rng(5)
    box = np.full((60, 50), 255)
    box[10, 10:41] = box[50, 10:41] = box[10:51, 10] = box[10:51, 40] = 0
    grids = [box, box.T, box.reshape(30, 100), *[np.where(rng.random((60, 50)) < 0.7, 255, 0) for _ in range(9)], box]
    rows = [(i, g.shape[1], g.ravel().tolist()) for i, g in enumerate(grids)]
    images = spark.createDataFrame(rows, "image_id long, width int, pixels array<int>").coalesce(1)
    outlines = spark.createDataFrame([(i, 0, 0, 30, 60) for i in (0, 3)], "image_id long, x1 int, y1 int, x2 int, y2 int")
    for held, polygon in ((None, {}), (outlines, {i: [(0, 0), (30, 0), (30, 60), (0, 60)] for i in (0, 3)})):
        want = [(i, k, *r.values()) for i, g in enumerate(grids) for k, r in enumerate(raster.found_rooms(g, polygon.get(i, ())), 1)]
        assert want and sorted(map(tuple, raster.rooms(images, held).collect())) == sorted(want)


def test_bands_of_edits_equal_the_whole():
    pick = random.Random(7)
    for _ in range(600):
        letters = pick.choice(("ab", "abcdefg \u00e9\U0001f600"))
        a = "".join(pick.choice(letters) for _ in range(pick.randint(1, 60)))
        b = "".join(c if pick.random() < 0.85 else pick.choice(("", c + c, "z")) for c in a) or "a"
        a, b = (a, b) if len(a) >= len(b) else (b, a)
        for most in range(max(1, len(a) - len(b)), len(b)):
            far = text._banded(a, b, most)
            assert far == text._bits(a, b) or far > most < text._bits(a, b)
    for n, share in ((2000, 0.02), (2000, 0.2), (3000, 0.9)):
        a = "".join(pick.choice("abcdefgh ") for _ in range(n))
        b = "".join(c if pick.random() > share else pick.choice(("", c + c, "z")) for c in a)
        assert text.edits(a, b) == text._bits(a, b)


def test_texts_are_spread_and_stand_as_objects_by_slices(spark, tmp_path, monkeypatch):
    rows = [(i, f"caf\u00e9 {i} " * 40) for i in range(500)] + [(500, None)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("leaderboard", "f1_nfkc", "f2_edit_distance", "f8_order_free", "f19_character_differences", "f22_similarity", "k3_differences"):
        assert "REPARTITION" in plan(catalog.QUERIES[name](spark, str(tmp_path)))
    most = []
    out = text.sliced(lambda v: most.append(v) or v * 2, pa.int64(), pa.array([1, None, 3] * 100), none=0)
    assert out.to_pylist() == [2, 0, 6] * 100 and len(most) == 200
    assert text.sliced(len, pa.int64(), pa.array([], pa.string())).to_pylist() == []


def test_small_and_large_pages_have_the_same_pairs(spark, monkeypatch):
    pick = random.Random(2)
    place = lambda: (pick.randint(0, 900), pick.randint(0, 700))
    points = [(k, i, *place()) for k, n in ((1, 6), (2, 90), (3, 4), (4, 0)) for i in range(n)]
    objects = [(k, i, *place(), *place()) for k, n in ((1, 5), (2, 80), (4, 3)) for i in range(n)]
    p = spark.createDataFrame(points, "k long, i long, px long, py long")
    o = spark.createDataFrame(objects, "k long, j long, x1 long, y1 long, x2 long, y2 long")
    want = {}
    for k, i, x, y in points:
        far = sorted((((x - (a + c) / 2) ** 2 + (y - (b + d) / 2) ** 2) ** 0.5, j) for m, j, a, b, c, d in objects if m == k)
        for r, (_, j) in enumerate([v for v in far if v[0] < 200][:3], 1):
            want[k, i, j] = r
    for small in (64, 0, 1000):
        monkeypatch.setattr(spatial, "SMALL", small)
        rows = spatial.nearest(p, o, "k", "i", "j", 200.0, 3).select("k", "i", "j", "rank")
        assert {tuple(r)[:3]: r["rank"] for r in rows.collect()} == want
    assert plan(spatial.nearest(p, o, "k", "i", "j", 200.0, 3)).count("explode") == 2  # of the large pages alone


def test_a_distance_is_taken_once_for_each_pair(spark):
    t = Tables(spark, DIR)
    rows = synthesis.associations(boxes._dimensions(t), boxes._elements(t), "result_id", "bbox_index", "object_id")
    assert plan(rows).upper().count("SQRT(") == 2  # on small and on large pages


def test_fuzzy_matches_take_few_distances_of_long_texts(monkeypatch):
    pick, taken = random.Random(4), []
    monkeypatch.setattr(spatial, "within", lambda a, b, most: taken.append(1) or text.within(a, b, most))
    pairs = ("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", " ", " ", " ")
    texts = ["".join(pick.choice(pairs) for _ in range(pick.randint(2900, 3000))) for _ in range(30)]
    read = ["".join(c if pick.random() < 0.93 else "#" for c in t) for t in texts]
    left = pa.table({"a": range(30), "n": [len(t) for t in read], "least": [0.92] * 30, "far": [-1] * 30, "mark": [""] * 30, "text": read})
    right = pa.table({"_b": range(30), "_n": [len(t) for t in texts], "_mark": [str(i) for i in range(30)], "_text": texts})
    got = spatial._best(left, right).sort_by("a")
    want = [1 - text.edits(a, b) / max(len(a), len(b)) for a, b in zip(read, texts)]
    assert dict(zip(got["a"].to_pylist(), zip(got["b"].to_pylist(), got["similarity"].to_pylist()))) == {i: (i, w) for i, w in enumerate(want) if w >= 0.92}
    assert 20 < len(taken) <= 30  # of 900 pairs


def test_fuzzy_matches_in_tiles_are_the_same(spark, monkeypatch):
    pick = random.Random(6)
    texts = ["".join(pick.choice("abc ") for _ in range(pick.choice((0, 3, 40, 41, 300)))) for _ in range(60)]
    texts += [t[:-1] + "z" for t in texts if t]
    left = spark.createDataFrame([(i, t.replace("ab", "a")) for i, t in enumerate(texts)] + [(None, "no id")], "i long, text string")
    right = spark.createDataFrame([*enumerate(texts), (None, "no id")], "j long, other string")
    have = lambda: sorted(map(tuple, spatial.fuzzy_nearest(left, right, "i", "j", 0.65).collect()))
    whole = have()
    monkeypatch.setattr(spatial, "TILE", 500)
    assert whole and have() == whole


def test_greedy_matching_takes_the_distance_of_two_texts_once():
    matching._distance.cache_clear()
    assert [matching._distance("4550", "4550x", 2) for _ in range(50)] == [1] * 50
    assert matching._distance.cache_info().misses == 1 and matching._distance.cache_info().maxsize


def test_boxes_are_sent_once_and_matched_once(spark):
    for name in ("x20_self_calibrated", "j15_greedy_match"):
        steps = plan(catalog.QUERIES[name](spark, DIR))
        assert len(re.findall(r"Exchange ", steps)) == 1 and steps.count("InArrow") + steps.count("ArrowEvalPython") == 1


def test_self_calibration_by_pages_equals_brute_force(spark):
    pick = random.Random(9)
    text = lambda: "".join(pick.choice("ab") for _ in range(pick.randint(1, 9)))
    box = lambda i: (i, text(), pick.randint(0, 990), pick.randint(0, 790), pick.choice((0, 20, 33)), pick.choice((0, 15, 41)))
    items = [(k, *box(i)) for k, n in ((1, 9), (2, 1), (3, 4), (5, 40), (None, 3)) for i in range(n)]
    refs = [(k, *box(i * 10)) for k, n in ((1, 5), (2, 1), (4, 3), (5, 25)) for i in range(n)]
    want, hows = [], set()
    for page in dict.fromkeys(r[0] for r in items):
        free, pairs, alone = [r[1:] for r in refs if r[0] == page], [], []
        for i in (r[1:] for r in items if r[0] == page):
            far = lambda r: matching._distance(i[1], r[1], 9)  # noqa: B023, E731
            tests = (("exact", lambda r: i[1] == r[1]), ("fuzzy", lambda r: far(r) <= 2), ("spatial", lambda r: ((i[2] - r[2]) ** 2 + (i[3] - r[3]) ** 2) ** 0.5 < 50 and far(r) <= 5))  # noqa: B023
            r, how = next(((r, how) for how, test in tests for r in free if test(r)), (None, None))
            if how:
                free.remove(r)
                pairs.append((i, r))
                want.append((page, i[0], i[1] if how == "exact" else r[1], *map(float, r[2:]), "matched"))
            else:
                alone.append(i)
            hows.add(how)
        mean = lambda v: np.floor(sum(v) / len(v) * 10000 + 0.5) / 10000 if v else 0.0
        dx, dy = (mean([i[c] - r[c] for i, r in pairs]) for c in (2, 3))
        sx, sy = (mean([i[c] / r[c] if r[c] > 0 else 0.0 for i, r in pairs]) or 1.0 for c in (4, 5))
        for i in alone:
            w, h = i[4] * sx, i[5] * sy
            x, y = max(0.0, min(i[2] - dx, 1000.0 - w)), max(0.0, min(i[3] - dy, 800.0 - h))
            w, h = max(10.0, min(w, 1000.0 - x)), max(10.0, min(h, 800.0 - y))
            want.append((page, i[0], i[1], *(float(np.floor(v + 0.5)) for v in (x, y, w, h)), "calibrated"))
    assert hows >= {"exact", "fuzzy", None}
    pick.shuffle(items)
    left = spark.createDataFrame(items, "k long, item_id long, text string, x long, y long, w long, h long")
    right = spark.createDataFrame(refs, "k long, ref_id long, text string, x long, y long, w long, h long")
    got = pipelines.self_calibrated(left, right, "k", 1000.0, 800.0)
    order = lambda rows: sorted(rows, key=lambda r: (r[0] or 0, r[1]))
    assert got.columns == ["k", "item_id", "text", "x", "y", "width", "height", "source"]
    assert order(map(tuple, got.collect())) == order(want)
    columns = ("text", "x", "y", "w", "h")
    both = left.withColumnRenamed("item_id", "id").withColumn("item", F.lit(True)).unionByName(right.withColumnRenamed("ref_id", "id").withColumn("item", F.lit(False)))
    item, ref = (F.when(F.col("item") == side, F.struct(F.col("id").alias(n), *columns)) for side, n in ((True, "item_id"), (False, "ref_id")))
    whole = pipelines.self_calibrated_pages(matching.pages(both, "k", item, ref), "k", 1000.0, 800.0)
    assert order(map(tuple, whole.collect())) == order(want)


def test_offsets_of_a_page_are_those_of_its_group(spark):
    names = ("x", "y", "w", "h", "x_b", "y_b", "w_b", "h_b")
    pick = random.Random(1)
    rows = [(k, *[pick.randint(0, 60) for _ in names]) for k, n in ((1, 1), (2, 7), (3, 30)) for _ in range(n)] + [(2, 5, None, 3, 4, 1, 2, None, 0), (4, *[None] * 8)]
    pairs = spark.createDataFrame(rows, "k long, " + ", ".join(f"{n} long" for n in names))
    pages = pairs.groupBy("k").agg(F.collect_list(F.struct(*names)).alias("p")).select("k", scaling.page_calibration("p").alias("o"))
    want = scaling.calibration(pairs, ["k"]).drop("n").orderBy("k").collect()
    assert pages.select("k", "o.*").orderBy("k").collect() == want
