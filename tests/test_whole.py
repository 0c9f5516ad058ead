"""Queries take the whole job: all rows and whole texts, against brute force; and SQL that covers a part
of the input holds on that part."""

import duckdb
import pytest
from pyspark.sql import functions as F
from tests.test_oracles import DIR, duck, rows  # noqa: F401

from quoin.functions import labels, text
from quoin.operators import spatial
from quoin.plans import catalog
from quoin.plans.fixtures import Tables

LONG = "the cat sat on the mat, " * 30 + "the end "
TEXTS = [(1, LONG, "en"), (2, "Gr\u00fc\u00dfe: the \U0001f600 tee bathe", "de"), (3, "th" * 150, "fr"), (4, "", "en"), (5, LONG[:-4] + "end. ", "es"), (6, "  ", "en"), (8, "le th\u00e9 e t", "fr"), (41, "e th e th", "en")]


def read(t):
    return t.replace("th", "t").replace("e ", "c ")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(TEXTS, "doc_id long, text string, lang string").write.parquet(f"{d}/documents.parquet")
    return d


def got(spark, folder, name):
    return sorted(map(tuple, catalog.QUERIES[name](spark, folder).collect()))


@pytest.mark.parametrize("name", sorted(catalog.PARTS))
def test_sql_on_its_part(spark, duck, name):  # noqa: F811
    part, sql = catalog.PARTS[name]
    have, want = part(spark, DIR).toPandas(), duck.execute(sql).df()
    assert sorted(have.columns) == sorted(want.columns)
    assert rows(have) == rows(want)


def test_bands_of_edit_distances(spark):
    pairs = [("a" * 900, "b" * 900), ("ab" * 500, "ba" * 450), ("x" * 700 + "y", "y" + "x" * 690), ("", "abc"), ("\u00fc" * 40, "u" * 45), ("k" * 300 + "l" * 60, "k" * 300)]
    have = spark.createDataFrame(pairs, "a string, b string").select(text.levenshtein("a", "b")).collect()
    assert [r[0] for r in have] == [distance(a, b) for a, b in pairs]


def test_whole_texts(spark, folder):
    some = [(i, t, read(t)) for i, t, _ in TEXTS if t]
    assert got(spark, folder, "f6_counts") == sorted((i, len(t) == len(read(t)), len(read(t)) - len(t)) for i, t, _ in TEXTS)
    assert got(spark, folder, "f17_words") == sorted((i, len(t.split())) for i, t, _ in TEXTS)
    assert got(spark, folder, "f7_sorted_form") == sorted((i, "".join(sorted("".join(t.split())))) for i, t, _ in TEXTS)
    assert got(spark, folder, "f5_coverage") == [(i, pytest.approx(100 * len(set(t) & set(r)) / len(set(t)), abs=1e-4)) for i, t, r in some]
    assert got(spark, folder, "f4_position_accuracy") == [(i, pytest.approx(100 * sum(x == y for x, y in zip(t, r)) / len(t), abs=1e-4)) for i, t, r in some]
    assert got(spark, folder, "u3_missed_words") == [(i, len(set(t.split(" ")) - set(read(t).split(" ")))) for i, t, _ in TEXTS]
    assert got(spark, folder, "u4_shared_characters") == [(i, len(set(t) & set(read(t)))) for i, t, _ in TEXTS]
    want = [(i, c, t.count(c) - r.count(c)) for i, t, r in some for c in {*t, *r} if t.count(c) != r.count(c)]
    assert got(spark, folder, "u5_character_multisets") == sorted(want)
    assert got(spark, folder, "p22_complete_inputs") == [(i,) for i, t, _ in TEXTS if t.strip(" ")]
    assert got(spark, folder, "f16_blocks") == [(i, 1) for i, _, _ in some]
    want = []
    for i, t, r in some:
        pad = [(k, *(s[k] if k < len(s) else "(end)" for s in (t, r))) for k in range(max(len(t), len(r)))]
        want += [(i, *p) for p in pad if p[1] != p[2]][:100]
    assert got(spark, folder, "f19_character_differences") == sorted(want)


def test_distances_of_whole_texts(spark, folder):
    near = lambda v: pytest.approx(v, abs=6e-5)
    some = [(i, t, read(t), distance(read(t), t)) for i, t, _ in TEXTS if t]
    assert got(spark, folder, "f2_edit_distance") == sorted((i, distance(read(t), t)) for i, t, _ in TEXTS)
    assert got(spark, folder, "f3_error_rate") == sorted((i, near(distance(read(t), t) / len(t)) if t else 0.0) for i, t, _ in TEXTS)
    assert got(spark, folder, "f21_precision_recall") == [(i, near((max(len(r), len(t)) - d) / len(r)), near((max(len(r), len(t)) - d) / len(t))) for i, t, r, d in some]
    assert got(spark, folder, "f22_similarity") == [(i, near(1 - d / max(len(r), len(t)))) for i, t, r, d in some]
    forms = [(i, *("".join(sorted("".join(s.split()))) for s in (r, t))) for i, t, r, _ in some if t.strip()]
    assert got(spark, folder, "f8_order_free") == [(i, near(distance(a, b) / max(len(a), len(b)))) for i, a, b in forms]


def test_leaderboard_of_all_rows(spark, folder):
    want = {}
    for i, t, _ in TEXTS:
        want.setdefault(f"tool{i % 5}", []).append(distance(read(t), t) / len(t) if t else 0.0)
    assert got(spark, folder, "leaderboard") == sorted((k, len(v), pytest.approx(sum(v) / len(v), abs=6e-5), v.count(0)) for k, v in want.items())


def test_fuzzy_matches_of_all_pairs(spark, folder):
    import random

    pick = random.Random(1)
    texts = [(i, t, read(t)) for i, t, _ in TEXTS] + [(i, t, "".join(pick.choice("ab \u00fc") if pick.random() < 0.2 else c for c in t)) for i in range(50, 90) for t in [TEXTS[i % 3][1][: pick.choice((12, 30, 31, 33, 90))]]]
    left, right = spark.createDataFrame([(i, r) for i, _, r in texts], "i long, text string"), spark.createDataFrame([(i + 7, t) for i, t, _ in texts], "j long, other string")
    for own in (right, right.withColumn("j", F.col("j") - 7)):
        ids = {t: j for j, t in sorted(((r["j"], r["other"]) for r in own.collect()), reverse=True)}
        want = []
        for i, _, r in texts:
            near = [(-(1 - distance(r, t) / max(len(r), len(t))), j) for t, j in ids.items() if r and t]
            near = [x for x in near if -x[0] >= 0.65]
            want += [(i, min(near)[1], -min(near)[0])] if near else []
        have = sorted(map(tuple, spatial.fuzzy_nearest(left, own, "i", "j", 0.65).collect()))
        assert have == sorted(want)
    assert [r[0] for r in got(spark, folder, "j14_fuzzy_match")] == [1, 2, 5, 6, 8]


@pytest.mark.parametrize("name", ["c2_line_runs", "c5_perimeter"])
def test_rasters_of_all_parts(spark, duck, name):  # noqa: F811
    want = []
    for i, size in duck.execute("select p_partkey, p_size from part").fetchall():
        m = 65 + size % 5
        if name == "c2_line_runs":
            want += [(i, k, at, 10, 110, 101) for k, at in [("horizontal", 10), ("horizontal", 110), ("vertical", 10), ("vertical", 110)] + [("vertical", m)] * (m % 2 == 0)]
        else:
            want.append((i, 20, 20, 100, 100))
    assert got(spark, DIR, name) == sorted(want)


def test_walls_of_all_results(spark, duck):  # noqa: F811
    want = {}
    for r, s in duck.execute("select l_orderkey, case when p_size % 7 = 0 then 'unknown' else coalesce(p_brand, 'unknown') end from lineitem join part on l_partkey = p_partkey where p_size % 4 = 0").fetchall():
        want.setdefault(s, []).append(r)
    assert max(map(max, want.values())) >= 400
    assert got(spark, DIR, "a7_grouped_walls") == sorted((s, len(v), ",".join(map(str, sorted(v)))) for s, v in want.items())


def test_durations_with_ties(spark, duck):  # noqa: F811
    from decimal import ROUND_HALF_UP, Decimal

    def shown(ms):
        if ms < 1000:
            return f"{ms}ms"
        if ms < 60000:
            return f"{Decimal(ms / 1000).quantize(Decimal('0.01'), ROUND_HALF_UP)}s"
        return f"{ms // 60000}m {(ms % 60000 + 500) // 1000}s"

    have = spark.range(0, 70_000).select("id", labels.duration("id")).collect()
    assert [tuple(r) for r in have] == [(i, shown(i)) for i in range(70_000)]
    times = duck.execute("select o_orderkey, cast(floor(o_totalprice) as bigint) % 70000 from orders").fetchall()
    assert any(ms % 10 == 5 for _, ms in times)
    assert got(spark, DIR, "f38_durations") == sorted((i, shown(ms)) for i, ms in times)


def test_boxes_with_an_edge_on_the_point(spark, monkeypatch):
    boxes = [(1, i, x, y, w, h) for i, (x, y, w, h) in enumerate((x, y, w, h) for x in (100, 400, 500, 501) for y in (100, 380, 400, 401) for w in (5, 20, 21) for h in (1, 15, 16))]
    boxes += [(2, 0, 500, 400, 1, 1), (3, 4, 400, 300, 5, 5), (4, 9, 100, 100, 90, 90)]

    def inside(x, y, w, h):
        points, hit = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)], False
        for i, (ax, ay) in enumerate(points):
            bx, by = points[i - 1]
            if (ay > 400) != (by > 400) and 500 < (bx - ax) * (400 - ay) / (by - ay) + ax:
                hit = not hit
        return hit

    held = spark.createDataFrame(boxes, "result_id long, bbox_index long, x long, y long, w long, h long")
    monkeypatch.setattr(Tables, "fx_boxes", held, raising=False)
    want = [(r, i, inside(x, y, w * 20, h * 20)) for r, i, x, y, w, h in boxes]
    assert got(spark, DIR, "g11_inside") == want
    top = {}
    for r, i, hit in want:
        top |= {r: max(i, top.get(r, i))} if hit else {}
    assert got(spark, DIR, "g12_topmost") == sorted(top.items())
