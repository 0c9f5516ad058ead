"""Answers' free words as the values that tables hold, and names of tools as they are shown."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What each field may hold, and the words that stand for categories, in the order they are tried.
SWINGS = ("left", "right", "both", "none", "unknown")
ROOMS = ("bedroom", "bathroom", "kitchen", "living", "dining", "hallway", "storage", "utility", "unknown")
METHODS = ("leader_line_alignment", "spatial_proximity", "semantic_understanding", "orientation_matching", "cumulative_calculation", "contextual_inference")
SEVERITIES = ("error", "warning", "info")
CATEGORIES = (
    "mathematical_inconsistency", "geometric_error", "dimension_mismatch", "missing_data", "unrealistic_value",
    "low_confidence", "association_conflict", "scale_error", "other",
)
CATEGORY_WORDS = (
    ("scaling", "scale_error"), ("scale", "scale_error"), ("mathematical", "mathematical_inconsistency"), ("math", "mathematical_inconsistency"),
    ("geometric", "geometric_error"), ("geometry", "geometric_error"), ("dimension", "dimension_mismatch"), ("missing", "missing_data"),
    ("unrealistic", "unrealistic_value"), ("confidence", "low_confidence"), ("association", "association_conflict"), ("architectural", "unrealistic_value"),
    ("plausibility", "unrealistic_value"), ("data_completeness", "missing_data"), ("completeness", "missing_data"),
)
CORRECTIONS = ("dimension_value", "coordinate", "association", "property", "classification")
GRADES = ("excellent", "good", "acceptable", "poor", "failed")
ABBREVIATIONS = (("gemini", "coordinates", "GC"), ("gemini", "validation", "GV"), ("gemini", "bbox", "GB"), ("cloud", "vision", "CV"), ("azure", "read", "AR"), ("azure", "layout", "AL"), ("azure", "document", "AD"))
#: Yen for one image, page, region or call.
RATES = {"image": 0.15, "read": 0.225, "layout": 1.5, "document": 0.225, "full": 0.05, "region": 0.02, "geometric": 1.5, "hybrid": 1.0}
CALIBRATION_BASE, CALIBRATION_EACH = 0.05 + 0.01 + 0.15, 0.02


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def one_of(value, allowed: tuple[str, ...], otherwise: str, empty: str | None = None) -> Column:
    """The lower-cased value if allowed, else ``otherwise``; ``empty`` for null and the empty text."""
    low = F.lower(_c(value))
    blank = low.isNull() | (low == "")
    return F.when(blank, F.lit(empty)).when(low.isin(*allowed), low).otherwise(F.lit(otherwise))


def swing(value) -> Column:
    return one_of(value, SWINGS, "unknown")


def room_type(value) -> Column:
    return one_of(value, ROOMS, "unknown")


def severity(value) -> Column:
    return one_of(value, SEVERITIES, "info", "info")


def grade(value) -> Column:
    return one_of(value, GRADES, "acceptable", "acceptable")


def correction(value) -> Column:
    return one_of(F.regexp_replace(_c(value), r"\s+", "_"), CORRECTIONS, "property", "property")


def method(value) -> Column:
    """The first of several; a method, or one whose letters without underscores it holds."""
    first = F.regexp_replace(F.lower(F.trim(F.split(_c(value), ",")[0])), r"\s+", "_")
    found = F.coalesce(*[F.when(F.contains(first, F.lit(m.replace("_", ""))), F.lit(m)) for m in METHODS], F.lit("contextual_inference"))
    return F.when(first.isin(*METHODS), first).otherwise(found)


def category(value) -> Column:
    """A category, else that of the first word the value holds, else ``other``."""
    low = F.regexp_replace(F.lower(_c(value)), r"\s+", "_")
    found = F.coalesce(*[F.when(F.contains(low, F.lit(w)), F.lit(c)) for w, c in CATEGORY_WORDS], F.lit("other"))
    return F.when(low.isin(*CATEGORIES), low).otherwise(found)


def abbreviation(tool) -> Column:
    """Of known pairs of words their letters, else the first letters of up to three parts."""
    t = _c(tool)
    known = [F.when(F.contains(t, F.lit(a)) & F.contains(t, F.lit(b)), F.lit(short)) for a, b, short in ABBREVIATIONS]
    parts = F.filter(F.split(t, "-"), lambda x: x != "")
    letters = F.array_join(F.transform(F.slice(parts, 1, 3), lambda x: F.upper(F.substring(x, 1, 1))), "")
    return F.coalesce(*known, F.when(letters != "", letters), F.upper(F.substring(t, 1, 2)))


def display_label(name, recommended, experimental) -> Column:
    mark = lambda on, text: F.when(_c(on), F.lit(text)).otherwise(F.lit(""))
    return F.concat(_c(name), mark(recommended, " (Recommended)"), mark(experimental, " (Experimental)"))


def estimated_cost(kind, n) -> Column:
    """Yen for ``n`` units; a calibrated reading pays its base and each unmatched text."""
    k = _c(kind)
    priced = reduce(lambda w, kr: w.when(k == kr[0], F.lit(kr[1]) * _c(n)), RATES.items(), F.when(k == "calibrated", F.lit(CALIBRATION_BASE) + F.lit(CALIBRATION_EACH) * _c(n)))
    return priced.otherwise(F.lit(0.0))


def cost_range(label) -> Column:
    """struct(lowest, highest) of a label like ``~0.5-1.5 yen per page``; null without a number."""
    part = lambda i: F.regexp_extract(_c(label), r"([0-9.]+)(?:-([0-9.]+))?", i).try_cast("double")
    return F.when(part(1).isNotNull(), F.struct(part(1).alias("lowest"), F.coalesce(part(2), part(1)).alias("highest")))


def shown_time(at) -> Column:
    """``Apr 9, 2024, 1:05 PM``."""
    return F.date_format(_c(at), "MMM d, yyyy, h:mm a")


def queue_eta(waiting, concurrency: int = 2, gap_ms: int = 2000, each_ms: int = 2000) -> Column:
    """Milliseconds until a queue is empty: batches of ``concurrency``, with gaps between them."""
    batches = F.ceil(_c(waiting) / F.lit(float(concurrency)))
    return F.when(_c(waiting) == 0, F.lit(0)).otherwise(batches * each_ms + (batches - 1) * gap_ms).cast("long")
