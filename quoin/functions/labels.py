"""Labels, colours and display formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .defaults import nvl_default


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _bands(value: Column, bands, last) -> Column:
    out = None
    for least, name in bands:
        out = F.when(value >= least, F.lit(name)) if out is None else out.when(value >= least, F.lit(name))
    return out.otherwise(F.lit(last))


def confidence_label(value) -> Column:
    return _bands(nvl_default(value, 1.0), ((0.95, "Excellent"), (0.85, "Good"), (0.75, "Medium")), "Low")


def confidence_colour(value, alpha: str = "1") -> Column:
    # fixed values: the palette of the review pages
    bands = ((0.95, "34, 197, 94"), (0.85, "234, 179, 8"), (0.75, "249, 115, 22"))
    return F.concat(F.lit("rgba("), _bands(nvl_default(value, 1.0), bands, "239, 68, 68"), F.lit(f", {alpha})"))


def _byte(x: Column) -> Column:
    return F.floor(x + F.lit(0.5)).cast("string")


def heat_colour(value) -> Column:
    c = nvl_default(value, 1.0)
    low, high = _byte(F.lit(255.0) * (c / 0.5)), _byte(F.lit(255.0) * (F.lit(1.0) - (c - 0.5) / 0.5))
    return F.when(c < 0.5, F.concat(F.lit("rgb(255, "), low, F.lit(", 0)"))).otherwise(F.concat(F.lit("rgb("), high, F.lit(", 255, 0)")))


def gradient_colour(value, metric: str) -> Column:
    """Green over orange to red by how bad a metric is; grey without a value."""
    v = _c(value).cast("double")
    if metric == "cer":
        bad = F.least(F.greatest(v * 100, F.lit(0.0)), F.lit(30.0)) / 30 * 100
    elif metric in ("accuracy", "coverage"):
        bad = (F.lit(100.0) - F.least(F.greatest(v, F.lit(50.0)), F.lit(100.0))) / 50 * 100
    else:
        bad = v
    first, second = bad / 50, (bad - 50) / 50
    mild = F.concat(F.lit("rgb("), _byte(76 + F.lit(179.0) * first), F.lit(", "), _byte(175 - F.lit(23.0) * first), F.lit(", "), _byte(80 - F.lit(80.0) * first), F.lit(")"))
    harsh = F.concat(F.lit("rgb(255, "), _byte(152 - F.lit(152.0) * second), F.lit(", 0)"))
    return F.when(v.isNull(), F.lit("rgb(128, 128, 128)")).when(bad <= 50, mild).otherwise(harsh)


def contrast_colour(rgb) -> Column:
    part = [F.regexp_extract(_c(rgb), r"rgb\((\d+),\s*(\d+),\s*(\d+)\)", i).try_cast("double") for i in (1, 2, 3)]
    light = (part[0] * 0.299 + part[1] * 0.587 + part[2] * 0.114) / 255
    return F.when(light.isNull() | (light > 0.5), F.lit("#000000")).otherwise(F.lit("#ffffff"))


def accuracy_class(value) -> Column:
    return _bands(_c(value), ((95, "excellent"), (85, "good"), (75, "medium")), "poor")


def _hundredths(x: Column) -> Column:
    """The nearest whole number of hundredths of the double itself, as toFixed has it: not of its shortest
    decimal form, and up at a tie. In two parts of few bits all products and the last sign are exact."""
    k = F.floor(x * 100)
    high = F.floor(x * 1048576.0) / 1048576.0
    return k + F.when((high * 100 - (k + F.lit(0.5))) + (x - high) * 100 >= 0, 1).otherwise(0)


def duration(ms) -> Column:
    c = _c(ms).cast("double")
    n = _hundredths(c / 1000)
    seconds = F.concat(F.floor(n / 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"), F.lit("s"))
    minutes = F.concat(F.floor(c / 60000).cast("string"), F.lit("m "), F.floor((c % 60000) / 1000 + 0.5).cast("string"), F.lit("s"))
    return F.when(c < 1000, F.concat(F.floor(c + 0.5).cast("string"), F.lit("ms"))).when(c < 60000, seconds).otherwise(minutes)


def yen(value) -> Column:
    return F.format_string("¥%.2f", _c(value).cast("double"))


def mime_type(path) -> Column:
    kinds = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "bmp": "image/bmp", "webp": "image/webp", "tiff": "image/tiff", "tif": "image/tiff", "pdf": "application/pdf"}
    table = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(F.element_at(F.split(_c(path), r"\."), -1))), F.lit("image/png"))


def feet_factor(unit) -> Column:
    u = _c(unit)
    return F.when(u == "mm", F.lit(1 / 304.8)).when(u == "meters", F.lit(3.28084)).otherwise(F.lit(1.0))


def is_pdf(path) -> Column:
    return F.lower(_c(path)).endswith(".pdf")
