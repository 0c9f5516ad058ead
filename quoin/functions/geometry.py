"""Points, boxes, segments and polygons as column expressions.

A point is ``struct<x double, y double>``, a polygon or box an array of points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def point(x, y) -> Column:
    return F.struct(_c(x).cast("double").alias("x"), _c(y).cast("double").alias("y"))


def rectangle(x, y, w, h) -> Column:
    """Four points: top left, top right, bottom right, bottom left."""
    x, y, w, h = map(_c, (x, y, w, h))
    return F.array(point(x, y), point(x + w, y), point(x + w, y + h), point(x, y + h))


def distance(ax, ay, bx, by) -> Column:
    dx, dy = _c(bx) - _c(ax), _c(by) - _c(ay)
    return F.sqrt((dx * dx + dy * dy).cast("double"))


def centre(points) -> Column:
    """The mean of the vertices; the origin for none."""
    p = _c(points)
    mean = lambda f: F.aggregate(p, F.lit(0.0), lambda a, v: a + v[f]) / F.size(p)
    return F.when(F.size(p) > 0, point(mean("x"), mean("y"))).otherwise(point(F.lit(0.0), F.lit(0.0)))


def bounds(points) -> Column:
    """struct(x, y, width, height) of the smallest upright rectangle."""
    p = _c(points)
    xs, ys = F.transform(p, lambda v: v["x"]), F.transform(p, lambda v: v["y"])
    x, y = F.array_min(xs), F.array_min(ys)
    return F.struct(x.alias("x"), y.alias("y"), (F.array_max(xs) - x).alias("width"), (F.array_max(ys) - y).alias("height"))


def padded(x, y, w, h, pad: float, width: float, height: float) -> Column:
    """A rectangle grown by ``pad`` inside the image; the size is clamped by the place before padding."""
    x, y, w, h = map(_c, (x, y, w, h))
    return F.struct(
        F.greatest(F.lit(0.0), x - pad).alias("x"),
        F.greatest(F.lit(0.0), y - pad).alias("y"),
        F.least(F.lit(width) - x, w + 2 * pad).alias("width"),
        F.least(F.lit(height) - y, h + 2 * pad).alias("height"),
    )


def ordered_box(points) -> Column:
    """Boxes of four points in canonical order; others as they are."""
    p, b = _c(points), bounds(points)
    return F.when(F.size(p) == 4, rectangle(b["x"], b["y"], b["width"], b["height"])).otherwise(p)


def four_points(points) -> Column:
    """Two corners become four points; others stay."""
    p, b = _c(points), bounds(points)
    return F.when(F.size(p) == 2, rectangle(b["x"], b["y"], b["width"], b["height"])).otherwise(p)


def flat_points(numbers) -> Column:
    """``[x1, y1, x2, y2, ...]`` as points."""
    n = _c(numbers)
    at = F.when(F.size(n) > 1, F.sequence(F.lit(0), F.size(n) - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: point(F.get(n, i), F.get(n, i + 1)))


def intersection_over_union(a, b) -> Column:
    """Of two bounds structs; 0 for an empty union."""
    a, b = _c(a), _c(b)
    w = F.greatest(F.lit(0.0), F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"]))
    h = F.greatest(F.lit(0.0), F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"]))
    union = a["width"] * a["height"] + b["width"] * b["height"] - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))


def overlaps(a, b) -> Column:
    """Whether two bounds structs touch."""
    a, b = _c(a), _c(b)
    return (a["x"] <= b["x"] + b["width"]) & (b["x"] <= a["x"] + a["width"]) & (a["y"] <= b["y"] + b["height"]) & (b["y"] <= a["y"] + a["height"])


def on_segment(px, py, ax, ay, bx, by) -> Column:
    """The point of a segment closest to p; a segment without length is its start."""
    px, py, ax, ay, bx, by = (_c(v).cast("double") for v in (px, py, ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    long = dx * dx + dy * dy
    t = F.when(long > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / long))).otherwise(F.lit(0.0))
    return point(ax + t * dx, ay + t * dy)


def segment_distance(px, py, ax, ay, bx, by) -> Column:
    q = on_segment(px, py, ax, ay, bx, by)
    return distance(px, py, q["x"], q["y"])


def object_distance(px, py, points) -> Column:
    """To a point, a segment of two points, or the centre of more; infinite for none."""
    p, c = _c(points), centre(points)
    a, b = F.get(p, F.lit(0)), F.get(p, F.lit(1))
    return (
        F.when(F.size(p) == 1, distance(px, py, a["x"], a["y"]))
        .when(F.size(p) == 2, segment_distance(px, py, a["x"], a["y"], b["x"], b["y"]))
        .when(F.size(p) > 2, distance(px, py, c["x"], c["y"]))
        .otherwise(F.lit(float("inf")))
    )


def inside(px, py, points, few: bool = False) -> Column:
    """Ray casting; polygons of fewer than three points give ``few``."""
    p, px, py = _c(points), _c(px), _c(py)
    at = F.when(F.size(p) > 2, F.sequence(F.lit(0), F.size(p) - 1)).otherwise(F.array().cast("array<int>"))

    def cross(acc, i):
        a, b = F.get(p, i), F.get(p, F.pmod(i - 1, F.size(p)))
        spans = (a["y"] > py) != (b["y"] > py)
        hit = spans & (px < (b["x"] - a["x"]) * (py - a["y"]) / F.when(spans, b["y"] - a["y"]).otherwise(F.lit(1.0)) + a["x"])
        return acc != hit

    return F.when(F.size(p) < 3, F.lit(few)).otherwise(F.aggregate(at, F.lit(False), cross))


def pixel_length(kind, points) -> Column:
    """Of a line of two points, or around a polygon; null otherwise."""
    p = _c(points)
    shifted = F.concat(F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), F.slice(p, 1, 1))
    around = F.aggregate(F.zip_with(p, shifted, lambda a, b: distance(a["x"], a["y"], b["x"], b["y"])), F.lit(0.0), lambda s, d: s + d)
    a, b = F.get(p, F.lit(0)), F.get(p, F.lit(1))
    return F.when((_c(kind) == "line") & (F.size(p) == 2), distance(a["x"], a["y"], b["x"], b["y"])).when((_c(kind) == "polygon") & (F.size(p) >= 2), around)


def percent_box(left, top, w, h, width, height) -> Column:
    """Percentages of the image as a rectangle in pixels."""
    at = lambda v, size: _c(v).cast("double") / 100 * size
    return F.struct(at(left, width).alias("x"), at(top, height).alias("y"), at(w, width).alias("width"), at(h, height).alias("height"))


def phrase_position(phrase) -> Column:
    """struct(x, y) in shares of the image that a phrase names (0.2, 0.5, 0.8); null without a keyword."""
    t = F.lower(_c(phrase))
    has = lambda *w: t.rlike("|".join(w))
    x = F.when(has("left"), F.lit(0.2)).when(has("right"), F.lit(0.8))
    y = F.when(has("top", "upper"), F.lit(0.2)).when(has("bottom", "lower"), F.lit(0.8))
    named = x.isNotNull() | y.isNotNull() | has("center", "middle")
    return F.when(named, F.struct(F.coalesce(x, F.lit(0.5)).alias("x"), F.coalesce(y, F.lit(0.5)).alias("y")))


def relation(fx, fy, tx, ty) -> Column:
    """``Npx right`` and so on, along the longer axis."""
    dx, dy = _c(tx) - _c(fx), _c(ty) - _c(fy)
    far = lambda v: F.floor(F.abs(v) + 0.5).cast("string")
    across = F.concat(far(dx), F.when(dx > 0, F.lit("px right")).otherwise(F.lit("px left")))
    along = F.concat(far(dy), F.when(dy > 0, F.lit("px below")).otherwise(F.lit("px above")))
    return F.when(F.abs(dx) > F.abs(dy), across).otherwise(along)


def clamped(x, y, w, h, width, height) -> Column:
    """A returned box inside the image, at least 10 wide and high, rounded."""
    from .defaults import or_default

    rounded = lambda v: F.floor(v + F.lit(0.5)).cast("double")
    place = lambda v, size, full, least: rounded(F.greatest(F.lit(0.0), F.least(_c(v).cast("double"), F.lit(float(full)) - or_default(size, least))))
    return F.struct(
        place(x, w, width, 50.0).alias("x"), place(y, h, height, 20.0).alias("y"),
        rounded(F.greatest(F.lit(10.0), or_default(w, 50.0))).alias("width"), rounded(F.greatest(F.lit(10.0), or_default(h, 20.0))).alias("height"),
    )


def feet(points, mm_per_pixel: float, height: float | None = None) -> Column:
    """Pixels as feet; with a height, y grows upwards."""
    y = (lambda v: F.lit(height) - v["y"]) if height is not None else (lambda v: v["y"])
    return F.transform(_c(points), lambda v: point(v["x"] * mm_per_pixel / 304.8, y(v) * mm_per_pixel / 304.8))


def column_label(index) -> Column:
    """0 is A, 25 is Z, 26 is AA."""
    i = _c(index).cast("int")
    letter = lambda v: F.chr(F.lit(65) + v)
    return F.when(i < 26, letter(i)).otherwise(F.concat(letter(F.floor(i / 26).cast("int") - 1), letter(i % 26)))


def column_index(label) -> Column:
    return F.aggregate(F.filter(F.split(_c(label), ""), lambda x: x != ""), F.lit(0), lambda a, x: a * 26 + F.ascii(x) - 64) - 1
