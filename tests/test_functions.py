"""Golden vectors of functions and operators, written by hand."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quoin.functions import defaults, geometry, labels, parsing, text
from quoin.operators import matching, raster, relational, scaling, spatial
from quoin.sources import exports, readers


def value(spark, column, **cols):
    row = spark.range(1)
    for name, v in cols.items():
        row = row.withColumn(name, F.lit(v))
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("a,b,rate", [("", "", 0.0), ("x", "", 1.0), ("", "abcd", 1.0), ("abc", "abc", 0.0), ("ab", "ba", 1.0), ("浴室", "浴槽", 0.5), ("abcdefgh", "ab", 3.0)])
def test_error_rate(spark, a, b, rate):
    assert value(spark, text.error_rate("a", "b"), a=a, b=b) == rate


def test_edit_distance_of_long_texts_is_sampled(spark):
    a, b = "a" * 20_001, "a" * 10_000 + "b" * 10_001
    want = 3 * sum(x != y for x, y in zip(a[::3], b[::3]))
    assert value(spark, text.edit_distance("a", "b"), a=a, b=b) == want
    assert value(spark, text.edit_distance("a", "b"), a="a" * 10_000, b="a" * 9_999) == 1


def test_normal_forms(spark):
    assert value(spark, text.normalized("a"), a="１２３ｱ") == "123ア"
    assert value(spark, text.normalized("a"), a="plain") == "plain"
    assert value(spark, text.sorted_form("a"), a="b　a\u00a0c ") == "abc"
    assert value(spark, text.order_free_accuracy("a", "b"), a="ab c", b="cab") == 100.0
    assert value(spark, text.order_free_accuracy("a", "b"), a=" ", b="") == 100.0


def test_text_shares(spark):
    assert value(spark, text.position_accuracy("a", "b"), a="abx", b="abcd") == 50.0
    assert value(spark, text.charset_coverage("a", "b"), a="abx", b="aabbcc") == pytest.approx(200 / 3)
    assert value(spark, text.similarity("a", "b"), a="", b="x") == 0.0
    assert value(spark, text.words("a"), a="第一、第二。 x　y") == ["第一", "第二", "x", "y"]
    assert value(spark, text.segments("a"), a="ab 図面 c") == ["ab", "図", "面", "c"]


def test_commentary(spark):
    got = value(spark, text.without_commentary("a"), a=" Extracted text: ```text\nX\n```\nNote: y ")
    assert (got["cleaned"], got["removed"]) == ("X", ["markdown code block", "Extracted text:", "trailing Note:"])
    assert value(spark, text.without_commentary("a"), a="plain")["had_commentary"] is False
    assert value(spark, text.without_openers("a"), a="テキスト: 図面 Anything else?") == "図面"
    assert value(spark, text.text_blocks("a"), a='「図」 and b') == ["図"]
    assert value(spark, text.text_blocks("a"), a="Found x\nab\nabc") == ["abc"]


def test_character_differences(spark):
    got = value(spark, text.character_differences("a", "b"), a="abx", b="abcd")
    assert [tuple(d) for d in got] == [(2, "c", "x"), (3, "d", "(end)")]
    assert value(spark, text.character_differences("a", "b"), a="", b="") == []


def test_interpolation_and_html(spark):
    assert value(spark, text.interpolated("a", F.create_map(F.lit("k"), F.lit("1"))), a="{{k}} {{z}}") == "1 {{z}}"
    assert value(spark, text.html_escaped("a"), a="<a href='x'>&") == "&lt;a href=&#039;x&#039;&gt;&amp;"


@pytest.mark.parametrize("raw,a,b,c,d", [("10,920", 10920.0, 10920.0, 10920.0, 10.0), ("3,500mm", 3500.0, 3500.0, 3500.0, 3.0), ("2.5m", 2.5, 2.5, 2.5, 2.0), ("800×1160", 800.0, 800.0, 800.0, 800.0), ("GL±0", None, None, None, 0.0), ("", None, None, None, None)])
def test_dimensions(spark, raw, a, b, c, d):
    got = [value(spark, f("a"), a=raw) for f in (parsing.dimension_value, parsing.dimension_in_units, parsing.dimension_before_mm, parsing.first_digits)]
    assert got == [a, b, c, d]


def test_parsers(spark):
    got = value(spark, parsing.coordinate_lines("a"), a="A|1|2|3|4x\nB|1|2|0|4\n|1|2|3|4\nC|101|1|1|1\nD|1|2|3")
    assert [tuple(r) for r in got] == [("A", 1.0, 2.0, 3.0, 4.0)]
    assert value(spark, parsing.has_coordinates("a"), a="x\na|1|2|3|4") is True
    assert value(spark, parsing.stated_confidence("a"), a="accuracy: 91.5 %") == 0.915
    assert value(spark, parsing.stated_confidence("a"), a="confidence 120 %") is None
    assert value(spark, parsing.without_fence("a"), a='```json\n{"a":1}\n```') == '{"a":1}'


def test_defaults(spark):
    rows = spark.createDataFrame([(None,), (0.0,), (float("nan"),), (0.5,)], "c double")
    assert [r[0] for r in rows.select(defaults.or_default("c", 1.0)).collect()] == [1.0, 1.0, 1.0, 0.5]
    assert rows.select(defaults.nvl_default("c", 1.0).alias("v")).collect()[1]["v"] == 0.0
    assert value(spark, defaults.js_round(F.lit(-2.5))) == -2.0
    assert value(spark, defaults.js_round(F.lit(1.25), 1)) == 1.3


def test_labels(spark):
    assert [value(spark, labels.confidence_label("a"), a=x) for x in (0.95, 0.85, 0.75, 0.7)] == ["Excellent", "Good", "Medium", "Low"]
    assert value(spark, labels.gradient_colour(F.lit(None).cast("double"), "cer")) == "rgb(128, 128, 128)"
    assert value(spark, labels.gradient_colour(F.lit(100.0), "accuracy")) == "rgb(76, 175, 80)"
    assert value(spark, labels.duration(F.lit(61_000))) == "1m 1s"
    assert value(spark, labels.mime_type(F.lit("a.TIF"))) == "image/tiff"


POINTS = "array<struct<x:double,y:double>>"


@pytest.mark.parametrize("p,d", [((-3, 4), 5.0), ((5, 2), 2.0), ((13, 4), 5.0)])
def test_segment_distance(spark, p, d):
    args = [F.lit(float(v)) for v in (*p, 0, 0, 10, 0)]
    assert value(spark, geometry.segment_distance(*args)) == d
    assert value(spark, geometry.segment_distance(*[F.lit(float(v)) for v in (3, 4, 0, 0, 0, 0)])) == 5.0


def test_boxes(spark):
    square = geometry.rectangle(F.lit(0), F.lit(0), F.lit(10), F.lit(10))
    assert value(spark, geometry.inside(F.lit(5.0), F.lit(5.0), square)) is True
    assert value(spark, geometry.inside(F.lit(15.0), F.lit(5.0), square)) is False
    assert value(spark, geometry.inside(F.lit(1.0), F.lit(1.0), F.array(geometry.point(F.lit(0), F.lit(0))), True)) is True
    b = geometry.bounds(square)
    assert value(spark, geometry.intersection_over_union(b, b)) == 1.0
    other = geometry.bounds(geometry.rectangle(F.lit(10), F.lit(0), F.lit(5), F.lit(5)))
    assert value(spark, geometry.overlaps(b, other)) is True and value(spark, geometry.intersection_over_union(b, other)) == 0.0
    assert value(spark, F.size(geometry.four_points(F.array(geometry.point(F.lit(1), F.lit(2)), geometry.point(F.lit(0), F.lit(5)))))) == 4
    assert value(spark, geometry.phrase_position(F.lit("near the Top-Right corner"))) == (0.8, 0.2)
    assert value(spark, geometry.phrase_position(F.lit("somewhere"))) is None


def test_grid_join_equals_all_pairs(spark):
    rng = np.random.default_rng(0)
    pts = [(1, i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-300, 300, (60, 2)))]
    obj = [(1, i, *map(float, v)) for i, v in enumerate(rng.uniform(-400, 400, (40, 4)))]
    p = spark.createDataFrame(pts, "k int, pid int, px double, py double")
    o = spark.createDataFrame(obj, "k int, oid int, x1 double, y1 double, x2 double, y2 double")

    def far(px, py, x1, y1, x2, y2):
        t = max(0, min(1, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2)))
        return np.hypot(px - x1 - t * (x2 - x1), py - y1 - t * (y2 - y1))

    want = {}
    for _, i, px, py in pts:
        d, j = min((far(px, py, *v), j) for _, j, *v in obj)
        if d < 80:
            want[i] = j
    got = spatial.nearest(p, o, "k", "pid", "oid", 80.0, segments=True).collect()
    assert {r.pid: r.oid for r in got} == want and len(got) == len(want)


def test_reading_order(spark):
    boxes = spark.createDataFrame([(1, 0, 30.0, 0.0), (1, 1, 20.0, 15.0), (1, 2, 10.0, 30.0)], "k long, b long, x double, y double")
    got = spatial.line_order(boxes, "k", "b").orderBy("place").collect()
    assert [(r.b, r.line) for r in got] == [(1, 0), (0, 0), (2, 1)]


def test_greedy_match(spark):
    items = spark.createDataFrame([(1, 1, "abc", 0.0, 0.0), (1, 2, "abc", 0.0, 0.0), (1, 3, "hello", 0.0, 0.0), (1, 4, "zzzzzz", 0.0, 0.0), (1, 5, "abcd", 0.0, 0.0)], "k long, item_id long, text string, x double, y double")
    refs = spark.createDataFrame([(1, 1, "abd", 0.0, 0.0), (1, 2, "abc", 0.0, 0.0), (1, 3, "hallo", 500.0, 0.0), (1, 4, "zyyyyy", 49.9, 0.0), (1, 5, "azcyqqq", 50.0, 0.0)], "k long, ref_id long, text string, x double, y double")
    got = {r.item_id: (r.ref_id, r.how) for r in matching.greedy_one_to_one(items, refs, "k").collect()}
    assert got == {1: (2, "exact"), 2: (1, "fuzzy"), 3: (3, "fuzzy"), 4: (4, "spatial")}


def test_edit_log(spark):
    log = [(1, 1, "add", "a", None), (1, 2, "add", "a", None), (1, 3, "add", "b", None), (1, 4, "modify", "c", "a"), (1, 5, "modify", "x", "nothing"), (1, 6, "delete", None, "a"), (1, 7, "add", "d", None)]
    edits = spark.createDataFrame(log, "k long, at long, op string, box string, old string")
    assert matching.folded_edits(edits, "k", ["at"]).first()["boxes"] == ["c", "b", "d"]


def test_scaling(spark):
    rows = spark.createDataFrame([(1, "wall", 100.0, 1500.0), (1, "door", 600.0, 9600.0), (1, "room", 5.0, 900.0)], "k int, object_type string, pixels double, mm double")
    groups = spark.createDataFrame([(1,), (2,)], "k int")
    got = {r.k: r for r in scaling.factor(scaling.anchors(rows), ["k"], groups).collect()}
    assert got[2].scale == 15.0 and got[2].confidence == 0.0
    assert got[1].n_anchors == 2 and got[1].scale == pytest.approx((15 * 0.9 + 16 * 0.8) / 1.7, abs=1e-4)
    robust = scaling.robust_factor(spark.createDataFrame([(1, 10.0, 1.0), (1, 10.0, 1.0), (1, 40.0, 1.0)], "k int, factor double, confidence double"), ["k"]).first()
    assert (robust.method, robust.scale, robust.confidence) == ("median", 10.0, 0.7)


def test_raster():
    grid = np.full((120, 120), 255)
    grid[20, 20:81] = grid[80, 20:81] = grid[20:81, 20] = grid[20:81, 80] = 0
    found = raster.found_rooms(grid)
    assert [(r["x1"], r["y1"], r["x2"], r["y2"], r["area"], r["points"]) for r in found] == [(21, 21, 79, 79, 59 * 59, [21, 21, 79, 21, 79, 79, 21, 79, 21, 22])]
    assert raster.found_rooms(grid, [(90, 90), (100, 90), (100, 100)]) == [] != raster.found_rooms(grid, [(40, 40), (60, 40), (60, 60), (40, 60)])
    line = np.array([[0, 0], [5, 1], [10, 0], [10, 10]], float)
    assert raster.simplified(line).tolist() == [[0, 0], [10, 0], [10, 10]]


def test_regions_equal_a_walk_over_pixels():
    rng = np.random.default_rng(3)
    for _ in range(20):
        grid = np.where(rng.random((60, 50)) < 0.62, 255, 0)
        want, seen = [], np.zeros(grid.shape, bool)
        for y in range(10, 50, 10):
            for x in range(10, 40, 10):
                if grid[y, x] > 128 and not seen[y, x]:
                    want.append(raster._walked(grid > 128, seen, y, x, 10**6))
                    seen |= want[-1]
        for cap in (10**6, 0 + 1):
            found = list(raster.regions(grid, cap=cap))
            if cap > 1:
                assert len(found) == len(want) and all((a == b).all() for a, b in zip(found, want))
            else:
                assert all(m.sum() == 1 for m in found)


def test_ordered_thickness_is_overwritten(spark):
    """The second line gets its distance from the first and looks no further; the last one counts for the first."""
    rows = [(1, "horizontal", 10, 0, 100), (1, "horizontal", 15, 0, 100), (1, "horizontal", 32, 0, 100), (1, "vertical", 12, 0, 100), (2, "horizontal", 12, 0, 100)]
    lines = spark.createDataFrame([(*r, 101) for r in rows], "image_id long, orientation string, at long, first long, last long, length long")
    got = {(r.image_id, r.orientation, r["at"]): r.thickness for r in raster.thickness(lines).collect()}
    assert got == {(1, "horizontal", 10): 22, (1, "horizontal", 15): 5, (1, "horizontal", 32): 22, (1, "vertical", 12): 1, (2, "horizontal", 12): 1}


@pytest.mark.parametrize("n,runs,walls", [(49, 0, 0), (50, 1, 0), (99, 1, 0), (100, 1, 1)])
def test_line_lengths(spark, n, runs, walls):
    lines = raster.line_runs(spark.createDataFrame([(1, x, 4, 0) for x in range(n)], "image_id long, x long, y long, v long"))
    assert (lines.count(), raster.walls(lines).count()) == (runs, walls)


def test_wall_thickness(spark):
    lines = spark.createDataFrame([(1, "horizontal", 10, 0, 100, 101), (1, "horizontal", 18, 50, 150, 101), (1, "horizontal", 60, 0, 100, 101)], "image_id long, orientation string, at long, first long, last long, length long")
    assert {r.at: r.thickness for r in raster.thickness(lines).collect()} == {10: 8, 18: 8, 60: 1}


def test_readers(spark, tmp_path):
    for f in ("a.png", "b.PDF", "c.pdf", "confidential/d.jpg"):
        (tmp_path / f).parent.mkdir(exist_ok=True)
        (tmp_path / f).write_bytes(b"x")
    assert {r.name for r in readers.drawing_files(spark, f"file://{tmp_path}").collect()} == {"a.png", "c.pdf"}
    deep = {r.name: r.confidential for r in readers.drawing_files(spark, f"file://{tmp_path}", True).collect()}
    assert deep == {"a.png": False, "c.pdf": False, "d.jpg": True}
    symbols = [{"symbols": [{"text": "A"}, {"text": "B"}]}, {"symbols": [{"text": "C"}]}]
    answer = json.dumps({"pages": [{"blocks": [{"paragraphs": [{"confidence": 0.9, "words": symbols, "boundingBox": {"vertices": [{"x": 1, "y": 2}]}}]}]}]})
    got = readers.paragraph_boxes(spark.createDataFrame([(answer,)], "answer string")).first()
    assert (got.text, got.confidence, got.page) == ("AB C", 0.9, 1)
    answer = json.dumps({"pages": [{"words": [{"content": "w", "confidence": 0.5, "polygon": [1, 2, 3, 4]}]}]})
    got = readers.word_boxes(spark.createDataFrame([(answer,)], "answer string")).first()
    assert (got.text, got.page, [tuple(p) for p in got.bounds]) == ("w", 1, [(1.0, 2.0), (3.0, 4.0)])
    answer = json.dumps({"text": "hello world", "pages": [{"tokens": [{"layout": {"confidence": 1, "textAnchor": {"textSegments": [{"endIndex": 5}, {"startIndex": 6, "endIndex": 8}]}}}]}]})
    assert readers.anchored_tokens(spark.createDataFrame([(answer,)], "answer string")).first().text == "hellowo"
    frame = lambda body: spark.createDataFrame([(json.dumps(body),)], "answer string")
    corners = {"normalizedVertices": [{"x": 0.5, "y": 0.25}]}
    body = {"text": "ab", "pages": [{"dimension": {"width": 200, "height": 400}, "tokens": [{"layout": {"boundingPoly": corners, "textAnchor": {"textSegments": [{"endIndex": 2}]}}}]}]}
    assert [tuple(v) for v in readers.anchored_tokens(frame(body)).first().bounds] == [(100.0, 100.0)]
    paragraph = lambda *w: {"words": [{"symbols": [{"text": c} for c in x]} for x in w]}
    got = readers.block_boxes(frame({"pages": [{"blocks": [{"confidence": 0.7, "paragraphs": [paragraph("AB", "C"), paragraph("D")]}]}]})).first()
    assert (got.text, got.confidence, got.page) == ("AB C\nD", 0.7, 1)
    got = readers.line_boxes(frame({"pages": [{"pageNumber": 3, "lines": [{"content": "l", "polygon": [1, 2]}]}]})).first()
    assert (got.text, got.page, got.confidence) == ("l", 3, None)
    cells = [{"rowIndex": 0, "columnIndex": 1, "content": "x"}]
    got = readers.table_cells(frame({"tables": [{"rowCount": 1, "columnCount": 2, "cells": cells}]})).first()
    assert (got.table, got.row, got.column, got.text) == (0, 0, 1, "x")
    pairs = [{"key": {"content": "k"}, "value": {"content": "v"}}, {"key": {"content": "k"}, "value": None}, {"key": {"content": "k"}}]
    assert [(r.key, r.value) for r in readers.key_values(frame({"keyValuePairs": pairs})).collect()] == [("k", "v")]
    (tmp_path / "a-metadata.json").write_text(json.dumps({"groundTruth": {"fullTextFile": "t.txt"}, "fullText": "whole"}))
    got = readers.side_cars(spark, f"file://{tmp_path}").first()
    assert (got.base, got.full_text, got.full_text_file) == ("a", "whole", "t.txt")


def test_accuracy_records(spark):
    from quoin.functions import records

    pairs = [("the cat", "the hat"), ("", "ab c"), ("same", "same"), ("", ""), ("ＡＢ x", "AB x"), ("xb " * 4000, "abc" * 4000), (None, "x")]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id int, got string, want string")
    have = {r.id: r.record for r in records.accuracy_records(rows, "got", "want").collect()}
    assert (have[0].distance, have[0].error_rate, have[0].order_free_distance, have[0].character_accuracy) == (1, 0.1429, 2, 85.71)
    assert [(d.position, d.want, d.got) for d in have[0].differences] == [(4, "h", "c")]
    assert (have[1].error_rate, have[1].order_free_accuracy, have[1].coverage, have[1].same_count) == (1.0, 0.0, 0.0, False)
    assert have[2].summary.splitlines()[-1] == "Perfect match!" and have[2].order_free_accuracy == 100.0
    assert (have[3].error_rate, have[3].order_free_error_rate, have[3].character_accuracy) == (0.0, 0.0, 100.0)
    assert have[4].distance == 0 and have[4].summary.splitlines()[0] == "Position-Sensitive Accuracy: 100.00%"
    assert len(have[5].differences) == 50 and have[5].summary.splitlines()[-1] == "Note: Large text detected (12000 chars) - using memory-efficient sampling mode"
    assert have[5].summary.splitlines()[-2] == "Found 50+ character differences"


def test_character_analysis(spark):
    from quoin.functions import records

    got = value(spark, records.character_analysis("a", "b"), a="aaa zz", b="abc cc xa、cab")
    assert got.missing_words == ["cc"]
    assert [(m.character, m["count"], m.source_words) for m in got.missing_characters] == [("b", 2, ["abc", "cab"]), ("c", 4, ["abc", "cab"]), ("x", 1, ["xa"])]
    assert [(e.character, e["count"]) for e in got.extra_characters] == [("z", 2)]
    assert (got.missing_total, got.extra_total) == (7, 2)


def test_exports(spark, tmp_path):
    row = (1, 2, "wall", None, 0, 0, 100, 0, '7"', 1500.0, 90)
    objects = spark.createDataFrame([row], "result_id long, object_id long, object_type string, sub_type string, x1 long, y1 long, x2 long, y2 long, dimension_text string, mm double, conf_pct long")
    got = exports.bim_rows(objects, 15.0)
    assert ",".join(got.columns) == exports.BIM_COLUMNS and got.first()["LengthVerified"] == "YES"
    exports.write_bim_csv(got, f"file://{tmp_path}/out")
    assert spark.read.option("header", True).option("escape", "\\").csv(f"file://{tmp_path}/out").count() == 1


def test_cascade_and_upsert(spark):
    results = spark.createDataFrame([(1, 10), (2, 10), (3, 11)], "result_id int, drawing_id int")
    left = relational.cascade(results.where("result_id = 1"), results, {"metrics": spark.createDataFrame([(1,), (3,)], "result_id int")})
    assert [r.result_id for r in left["results"].collect()] == [3] and left["metrics"].count() == 1


def test_champions_have_a_value(spark):
    from quoin.operators.aggregates import champions

    stats = spark.createDataFrame([("a", None, 3.0), ("b", 2.0, 3.0), ("c", 1.0, None)], "tool string, rate double, cost double")
    got = champions(stats, {"most": ("rate", True), "least": ("rate", False), "cheapest": ("cost", False)}).first()
    assert tuple(got) == ("b", "c", "a")


def test_edit_distance_by_bits():
    rng = np.random.default_rng(5)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for _ in range(300):
        a, b = ("".join(rng.choice(list("abé😀"), rng.integers(0, 90))) for _ in range(2))
        assert text._bits(a, b) == plain(a, b)
