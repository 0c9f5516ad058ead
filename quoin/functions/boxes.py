"""Edits, estimates and calibrated places of boxes, as column expressions on x, y, width and height."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST = 10
CORNERS = ("top-left", "top", "top-right", "right", "bottom-right", "bottom", "bottom-left", "left")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _rect(x1, y1, x2, y2) -> Column:
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def moved(box, dx, dy) -> Column:
    b = _c(box)
    return _rect(b["x1"] + _c(dx), b["y1"] + _c(dy), b["x2"] + _c(dx), b["y2"] + _c(dy))


def resized(box, handle, x, y) -> Column:
    """The side or corner that ``handle`` names goes to (x, y); a box stays at least 10 wide and high."""
    b, h, x, y = _c(box), _c(handle), _c(x), _c(y)
    left, right, top, bottom = (F.contains(h, F.lit(s)) for s in ("left", "right", "top", "bottom"))
    x1, x2 = F.when(left, x).otherwise(b["x1"]), F.when(right, x).otherwise(b["x2"])
    y1, y2 = F.when(top, y).otherwise(b["y1"]), F.when(bottom, y).otherwise(b["y2"])
    thin, flat = x2 - x1 < LEAST, y2 - y1 < LEAST
    return _rect(
        F.when(thin & left, x2 - LEAST).otherwise(x1), F.when(flat & top, y2 - LEAST).otherwise(y1),
        F.when(thin & ~left, x1 + LEAST).otherwise(x2), F.when(flat & ~top, y1 + LEAST).otherwise(y2),
    )


def dragged(x0, y0, x1, y1) -> Column:
    """The box between two corners in any order."""
    a, b, c, d = map(_c, (x0, y0, x1, y1))
    return _rect(F.least(a, c), F.least(b, d), F.greatest(a, c), F.greatest(b, d))


def held_in(box, width, height) -> Column:
    b = _c(box)
    at = lambda v, n: F.greatest(F.lit(0), F.least(F.lit(n), v))
    return _rect(at(b["x1"], width), at(b["y1"], height), at(b["x2"], width), at(b["y2"], height))


def hit_handle(box, x, y, scale: float = 1.0, size: float = 8.0) -> Column:
    """The first handle within reach of a point, clockwise from the top left; null without one."""
    b, px, py = _c(box), _c(x), _c(y)
    mx, my = (b["x1"] + b["x2"]) / 2.0, (b["y1"] + b["y2"]) / 2.0
    places = ((b["x1"], b["y1"]), (mx, b["y1"]), (b["x2"], b["y1"]), (b["x2"], my), (b["x2"], b["y2"]), (mx, b["y2"]), (b["x1"], b["y2"]), (b["x1"], my))
    near = lambda p: F.sqrt((px - p[0]) * (px - p[0]) + (py - p[1]) * (py - p[1])) <= size / scale
    return F.coalesce(*[F.when(near(p), F.lit(name)) for name, p in zip(CORNERS, places)])


def _rounded(v: Column) -> Column:
    return F.floor(v + F.lit(0.5)).cast("double")


def _calibrated(x, y, w, h, offset) -> tuple[Column, ...]:
    """Place less offset, size by scale. offset: struct(left, top, scale_x, scale_y, confidence)."""
    o = _c(offset)
    return _c(x) - o["left"], _c(y) - o["top"], _c(w) * o["scale_x"], _c(h) * o["scale_y"]


def calibrated(x, y, w, h, offset, anchor_distance, width: float, height: float, reach: float = 500.0) -> Column:
    """A place by learned offsets, inside the image. An anchor nearer than ``reach`` makes it surer."""
    cx, cy, cw, ch = _calibrated(x, y, w, h, offset)
    sure = _c(offset)["confidence"]
    near = F.coalesce(_c(anchor_distance) < reach, F.lit(False))
    px, py = F.greatest(F.lit(0.0), F.least(cx, F.lit(width) - cw)), F.greatest(F.lit(0.0), F.least(cy, F.lit(height) - ch))
    pw, ph = F.greatest(F.lit(10.0), F.least(cw, F.lit(width) - px)), F.greatest(F.lit(10.0), F.least(ch, F.lit(height) - py))
    return F.struct(
        _rounded(px).alias("x"), _rounded(py).alias("y"), _rounded(pw).alias("width"), _rounded(ph).alias("height"),
        F.when(near, F.least(F.lit(0.95), sure + 0.1)).otherwise(sure).alias("confidence"), F.when(near, F.lit("anchor-refined")).otherwise(F.lit("offset-only")).alias("method"),
    )


def fallback_calibrated(x, y, w, h, offset, width: float, height: float) -> Column:
    """Where reasoning failed: offsets alone, at least 20 by 10, less sure."""
    cx, cy, cw, ch = _calibrated(x, y, w, h, offset)
    return F.struct(
        _rounded(F.greatest(F.lit(0.0), F.least(cx, F.lit(width - 50)))).alias("x"), _rounded(F.greatest(F.lit(0.0), F.least(cy, F.lit(height - 20)))).alias("y"),
        _rounded(F.greatest(F.lit(20.0), cw)).alias("width"), _rounded(F.greatest(F.lit(10.0), ch)).alias("height"), (_c(offset)["confidence"] * 0.7).alias("confidence"),
    )


def offset_only(x, y, w, h, offset) -> Column:
    """The plainest fallback: neither clamped nor rounded, least sure."""
    cx, cy, cw, ch = _calibrated(x, y, w, h, offset)
    return F.struct(cx.alias("x"), cy.alias("y"), cw.alias("width"), ch.alias("height"), (_c(offset)["confidence"] * 0.6).alias("confidence"))


def beside(n_chars, neighbour, char_width, char_height, width: float, height: float) -> Column:
    """A box for ``n_chars`` characters after its nearest neighbour (struct x1, y1, x2, y2): below it if it is
    upright (higher than 1.5 times its width), else to its right, half a character away; without a
    neighbour in the middle of the image."""
    b, w, h = _c(neighbour), _c(char_width) * _c(n_chars), _c(char_height)
    upright = F.abs(b["y2"] - b["y1"]) > F.abs(b["x2"] - b["x1"]) * 1.5
    x = F.when(upright, b["x1"].cast("double")).otherwise(b["x2"] + _c(char_width) * 0.5)
    y = F.when(upright, b["y2"] + h * 0.5).otherwise(b["y1"].cast("double"))
    inside = lambda v, full: F.least(F.greatest(v, F.lit(0.0)), full)
    alone = b.isNull()
    px = F.when(alone, (F.lit(width) - w) / 2).otherwise(inside(x, F.lit(width) - w))
    py = F.when(alone, (F.lit(height) - h) / 2).otherwise(inside(y, F.lit(height) - h))
    return F.struct(px.alias("x"), py.alias("y"), w.alias("width"), h.cast("double").alias("height"), F.when(alone, 0.5).otherwise(0.6).alias("confidence"))


def square_metres(area, mm_per_pixel) -> Column:
    s = _c(mm_per_pixel)
    return F.coalesce(_c(area) * s * s / 1000000, F.lit(0.0))
