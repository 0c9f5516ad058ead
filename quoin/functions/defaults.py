"""Defaults, rounding and divisions as the evaluated system defines them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def or_default(value, default) -> Column:
    """``default`` for null, zero and NaN."""
    c = F.col(value) if isinstance(value, str) else value
    return F.when(c.isNull() | (c == 0) | F.isnan(c.cast("double")), F.lit(default)).otherwise(c)


def text_or_default(value, default: str) -> Column:
    """``default`` for null and the empty text."""
    c = F.col(value) if isinstance(value, str) else value
    return F.when(c.isNull() | (c == ""), F.lit(default)).otherwise(c)


def nvl_default(value, default) -> Column:
    """``default`` for null only."""
    return F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(default))


def js_round(value, digits: int = 0) -> Column:
    """Halves go up, towards positive infinity."""
    c = F.col(value) if isinstance(value, str) else value
    p = float(10**digits)
    return F.floor(c * F.lit(p) + F.lit(0.5)).cast("double") / F.lit(p)


def share(part, whole) -> Column:
    """A percentage, 0 where the whole is 0."""
    p = F.col(part) if isinstance(part, str) else part
    w = F.col(whole) if isinstance(whole, str) else whole
    return F.when(w > 0, p * F.lit(100.0) / w).otherwise(F.lit(0.0))


def leading_number(value) -> Column:
    """The number a text begins with; null without one. What follows is ignored."""
    c = F.col(value) if isinstance(value, str) else value
    return F.regexp_extract(c, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")
