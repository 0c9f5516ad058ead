"""Metrics of texts above 10 000 characters take whole texts, against brute force."""

import random

import numpy as np
import pytest

from quoin.plans import catalog

PICK = random.Random(3)
LONG = {1: "ab" * 5000 + "th" * 101, 2: "".join(PICK.choice(("the ", "a", "th", "e ", "ü", "x")) for _ in range(6000)), 6: "th" * 20}


def read(t):
    return t.replace("th", "t").replace("e ", "c ")


def form(t):
    return "".join(sorted("".join(t.split())))


def distance(a, b):
    a, b = (np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in (a, b))
    places = np.arange(len(b) + 1)
    row = places.copy()
    for i, c in enumerate(a, 1):
        new = np.append(i, np.minimum(row[1:] + 1, row[:-1] + (b != c)))
        row = np.minimum.accumulate(new - places) + places
    return int(row[-1])


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("long"))
    spark.createDataFrame([(i, t, "en") for i, t in LONG.items()], "doc_id long, text string, lang string").write.parquet(f"{d}/documents.parquet")
    return d


def got(spark, folder, name):
    return sorted(map(tuple, catalog.QUERIES[name](spark, folder).collect()))


def near(v):
    return pytest.approx(v, abs=5.1e-5)


def test_precision_and_recall_of_long_texts(spark, folder):
    right = {i: max(len(t), len(read(t))) - distance(read(t), t) for i, t in LONG.items()}
    assert max(map(len, LONG.values())) > 10_000
    assert got(spark, folder, "f21_precision_recall") == [(i, near(right[i] / len(read(t))), near(right[i] / len(t))) for i, t in LONG.items()]


def test_edit_distance_of_long_texts(spark, folder):
    assert got(spark, folder, "f2_edit_distance") == [(i, distance(read(t), t)) for i, t in LONG.items()]


def test_order_free_rate_of_long_texts(spark, folder):
    forms = [(i, form(read(t)), form(t)) for i, t in LONG.items()]
    assert got(spark, folder, "f8_order_free") == [(i, near(distance(a, b) / max(len(a), len(b)))) for i, a, b in forms]


def test_error_rates_of_long_texts(spark, folder):
    rates = {i: distance(read(t), t) / len(t) for i, t in LONG.items()}
    assert got(spark, folder, "f3_error_rate") == [(i, near(r)) for i, r in rates.items()]
    assert got(spark, folder, "leaderboard") == [("tool1", 2, near((rates[1] + rates[6]) / 2), 0), ("tool2", 1, near(rates[2]), 0)]


def test_accuracy_records_take_all_measures_of_a_pair_together(spark):
    from quoin.functions import records, text

    pairs = [(read(t), t) for t in LONG.values()] + [("a b　\x0b", "ba\x85﻿\x1c"), ("", ""), ("", "x\U0001f600y"), ("x", ""), (None, "x y"), ("x", None)]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id int, a string, b string")
    have = records.accuracy_records(rows, "a", "b")
    assert "levenshtein" not in have._jdf.queryExecution().optimizedPlan().toString()  # distances are taken with all else
    got = [[r.id, m.distance, m.order_free_distance, m.read_length, m.truth_length, m.character_accuracy, m.coverage, m.differences] for r in have.orderBy("id").collect() for m in [r.record]]
    a, b = text.normalized("a"), text.normalized("b")
    forms = [text.sorted_form(v) for v in (a, b)]
    two = lambda c: records.js_round(c, 2)
    one = rows.select("id", text.edit_distance(a, b), text.edit_distance(*forms), *map(records.F.length, forms), two(text.position_accuracy(a, b)), two(text.charset_coverage(a, b)), text.character_differences(a, b))
    assert got == [list(r) for r in one.orderBy("id").collect()]
