"""Scaling factors, calibration and data quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.defaults import js_round

FALLBACK = 15.0


def anchors(objects: DataFrame) -> DataFrame:
    """Objects (object_type, pixels, mm) that can set a scale: at least 10 pixels and 100 mm."""
    rows = objects.where("pixels >= 10 and mm >= 100").withColumn("factor", F.col("mm") / F.col("pixels"))
    base = F.when(F.col("object_type") == "wall", 0.9).when(F.col("object_type").isin("door", "window"), 0.7).otherwise(0.5)
    bonus = F.when(F.col("pixels") > 500, 0.1).otherwise(0.0) + F.when(F.col("pixels") > 700, 0.1).otherwise(0.0)
    return rows.withColumn("confidence", F.least(F.lit(1.0), base + bonus))


def factor(rows: DataFrame, keys: list[str], groups: DataFrame) -> DataFrame:
    """Confidence-weighted factor of each group's anchors with its spread; groups without any get the
    fallback. The largest deviation comes from the extremes, so one aggregate does."""
    w = F.sum(F.col("factor") * F.col("confidence")) / F.sum("confidence")
    sums = rows.groupBy(*keys).agg(w.alias("scale"), F.count("*").alias("n_anchors"), F.stddev_pop("factor").alias("spread"), F.min("factor").alias("low"), F.max("factor").alias("high"), F.min("confidence").alias("least"))
    out = groups.join(sums, keys, "left")
    scale = F.coalesce("scale", F.lit(FALLBACK))
    deviation = F.coalesce(F.greatest(F.col("high") - F.col("scale"), F.col("scale") - F.col("low")) / F.col("scale") * 100, F.lit(0.0))
    n = F.coalesce("n_anchors", F.lit(0))
    sure = F.least(F.lit(1.0), F.col("least") + F.when(n >= 3, 0.1).otherwise(0.0) + F.when(deviation < 5, 0.1).otherwise(0.0))
    return out.select(*keys, js_round(scale, 4).alias("scale"), n.alias("n_anchors"), js_round(F.coalesce("spread", F.lit(0.0)), 4).alias("spread"), js_round(deviation, 4).alias("max_deviation"), js_round(F.when(n > 0, sure).otherwise(F.lit(0.0)), 4).alias("confidence"))


def robust_factor(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted mean, or the median where the coefficient of variation is above 20 %."""
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("factor").alias("lo"), F.max("factor").alias("hi"), F.avg("factor").alias("mean"), F.median("factor").alias("median"),
        F.stddev_pop("factor").alias("sd"), (F.sum(F.col("factor") * F.col("confidence")) / F.sum("confidence")).alias("weighted"), F.avg("confidence").alias("sure"),
    )
    cv = F.col("sd") / F.col("mean") * 100
    few = F.when(F.col("n") < 3, 0.8).otherwise(1.0) * F.when(cv > 15, 0.7).otherwise(1.0)
    scale = js_round(F.when(cv > 20, F.col("median")).otherwise(F.col("weighted")), 3)
    return sums.select(*keys, "n", scale.alias("scale"), F.when(cv > 20, F.lit("median")).otherwise(F.lit("weighted_average")).alias("method"), js_round(F.col("sure") * few, 2).alias("confidence"), js_round("sd", 3).alias("sd"))


def _offsets(mean, spread) -> list[Column]:
    """Of matched boxes (x, y, w, h and their counterparts _b). ``mean`` and ``spread`` take a function of a
    function that gives a pair's column by name."""
    ratio = lambda a, b: mean(lambda c: F.when(c(b) > 0, c(a) / c(b)).otherwise(0.0))
    dy = lambda c: c("y") - c("y_b")
    sure = F.greatest(F.lit(0.3), F.least(F.lit(0.9), F.lit(1.0) - spread(dy) / 100))
    return [
        js_round(mean(lambda c: c("x") - c("x_b")), 4).alias("dx"), js_round(mean(dy), 4).alias("dy"), js_round(ratio("w", "w_b"), 4).alias("scale_x"),
        js_round(ratio("h", "h_b"), 4).alias("scale_y"), js_round(sure, 4).alias("confidence"),
    ]


def calibration(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Mean offsets and scale ratios of matched boxes (x, y, w, h and their counterparts _b); a box
    without width or height adds nothing to the ratios but counts."""
    offsets = _offsets(lambda v: F.avg(v(F.col)), lambda v: F.stddev_pop(v(F.col)))
    return pairs.groupBy(*keys).agg(*offsets, F.count("*").alias("n"))


def page_calibration(pairs: str) -> Column:
    """``calibration`` of an array of structs, as a struct without n; null for an empty array."""

    def average(values: Column) -> Column:
        total = F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
        return F.when(F.size(values) > 0, total / F.size(values))

    def each(v) -> Column:
        return F.array_compact(F.transform(pairs, lambda p: v(lambda n: p[n]).cast("double")))

    def spread(v) -> Column:
        centre = average(each(v))
        return F.sqrt(average(F.transform(each(v), lambda d: (d - centre) * (d - centre))))

    # greatest and least pass over nulls: an empty array would be sure
    return F.when(F.size(pairs) > 0, F.struct(*_offsets(lambda v: average(each(v)), spread)))


WEIGHTS = {"has_coordinates": 3.0, "has_length": 2.0, "has_text": 2.0, "has_thickness": 1.5, "has_height": 1.5, "has_level": 1.0}


def completeness() -> Column:
    """Weighted share of the properties that an element has, in percent."""
    have = None
    for name, weight in WEIGHTS.items():
        v = F.when(F.col(name), F.lit(weight)).otherwise(F.lit(0.0))
        have = v if have is None else have + v
    return have / sum(WEIGHTS.values()) * 100


def issues() -> Column:
    """Problems of an element as structs (severity, message)."""
    at = lambda on, s, m: F.when(on, F.struct(F.lit(s).alias("severity"), F.lit(m).alias("message")))
    wall = F.col("object_type") == "wall"
    return F.array_compact(F.array(
        at(~F.col("has_coordinates"), "error", "no coordinates"),
        at(wall & ~F.col("has_length") & ~F.col("has_text"), "warning", "wall without length or text"),
        at(wall & ~F.col("has_thickness"), "info", "wall without thickness"),
    ))


def verified_length(length, expected, tolerance: float = 0.05) -> Column:
    e = F.col(expected) if isinstance(expected, str) else expected
    return F.abs((F.col(length) if isinstance(length, str) else length) - e) <= tolerance * e


def first_scale(objects: DataFrame, key: str, order: str, default: float = 100.0) -> DataFrame:
    """mm for a pixel of each page by its first object with a text and a length: the text's first digits over
    the pixels; ``default`` without one."""
    good = (F.length("text") > 0) & (F.col("pixels") > 0)
    first = F.min(F.when(good, F.struct(F.col(order).alias("o"), F.col("text").alias("t"), F.col("pixels").alias("p"))))
    rows = objects.groupBy(key).agg(first.alias("f"))
    mm = F.regexp_extract("f.t", r"(\d+)", 1).try_cast("double")
    return rows.select(key, F.coalesce(mm / F.col("f.p"), F.lit(default)).alias("scale"))


def with_anchor(boxes: DataFrame, anchors: DataFrame, key: str, box_id: str) -> DataFrame:
    """Boxes with the distance of their centre to the nearest anchor's on the page (null without one): a
    minimum over the page's anchors, as a partial aggregate."""
    centre = lambda df, s: df.withColumns({f"cx{s}": F.col("x") + F.col("w") / 2.0, f"cy{s}": F.col("y") + F.col("h") / 2.0})
    pairs = centre(boxes, "").select(key, box_id, "cx", "cy").join(centre(anchors, "_a").select(key, "cx_a", "cy_a"), key)
    dx, dy = F.col("cx") - F.col("cx_a"), F.col("cy") - F.col("cy_a")
    near = pairs.groupBy(key, box_id).agg(F.min(F.sqrt(dx * dx + dy * dy)).alias("anchor_distance"))
    return boxes.join(near, [key, box_id], "left")


def page_anchor(box: Column, anchors: str) -> Column:
    """``with_anchor``'s distance of a struct (x, y, w, h) to an array of them."""
    centre = lambda b: (b["x"] + b["w"] / 2.0, b["y"] + b["h"] / 2.0)
    cx, cy = centre(box)

    def far(a: Column) -> Column:
        ax, ay = centre(a)
        return F.sqrt((cx - ax) * (cx - ax) + (cy - ay) * (cy - ay))

    return F.array_min(F.transform(anchors, far))


# What an element needs, and what is put where it has none (mm).
REQUIRED = {"wall": ("length", "thickness", "height"), "door": ("width", "height"), "window": ("width", "height"), "room": ("label",)}
USUAL = {"wall": {"thickness": 150, "height": 2700}, "door": {"width": 900, "height": 2000}, "window": {"width": 1200, "height": 1200}}
EXTERIOR_THICKNESS = 200


def missing_required() -> Column:
    """How many of the properties that its type needs an element lacks (null, 0 and empty texts are none)."""
    out = None
    for kind, names in REQUIRED.items():
        lacks = [F.coalesce(F.col(n), F.lit("")) == "" if n == "label" else F.coalesce(F.col(n), F.lit(0)) <= 0 for n in names]
        n = sum((x.cast("int") for x in lacks[1:]), lacks[0].cast("int"))
        out = F.when(F.col("object_type") == kind, n) if out is None else out.when(F.col("object_type") == kind, n)
    return out.otherwise(F.lit(0))


def imputed(elements: DataFrame, exterior: Column) -> DataFrame:
    """Elements with usual values where they have none; ``<property>_set`` says where that was done."""
    out = elements
    for name in ("thickness", "width", "height"):
        usual = F.lit(None).cast("int")
        for kind, values in USUAL.items():
            if name in values:
                value = F.when(exterior, EXTERIOR_THICKNESS).otherwise(values[name]) if (kind, name) == ("wall", "thickness") else F.lit(values[name])
                usual = F.when(F.col("object_type") == kind, value).otherwise(usual)
        put = (F.coalesce(F.col(name), F.lit(0)) == 0) & usual.isNotNull()
        out = out.withColumns({f"{name}_set": put, name: F.when(put, usual).otherwise(F.col(name))})
    return out


#: Plausible sizes in mm by type.
PLAUSIBLE = {"wall": (500, 20_000), "door": (600, 1000), "window": (600, 2000)}


def checks(objects: DataFrame, dimensions: DataFrame, associated: DataFrame, keys: list[str], width: float, height: float, sure: float = 0.5) -> DataFrame:
    """Deterministic checks of a document: check_name, affected. An extra of this engine; readers' own verdicts
    are input. objects: object_type, x1, y1, x2, y2, mm, said, confidence."""
    c = F.col
    outside = (c("x1") < 0) | (c("y1") < 0) | (c("x2") > width) | (c("y2") > height)
    odd = F.lit(False)
    for kind, (low, high) in PLAUSIBLE.items():
        odd = odd | (c("object_type") == kind) & ((c("mm") < low) | (c("mm") > high))
    off = lambda share: F.abs(c("mm") - c("said")) > share * c("said")
    found = {"outside image": outside, "implausible size": odd, "length off by 5 %": off(0.05), "length off by 10 %": off(0.1), "low confidence": c("confidence") < sure}
    counts = objects.agg(*[F.count_if(v).alias(n) for n, v in found.items()])
    rows = counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check_name"), c(f"`{n}`").alias("affected")) for n in found])).alias("r")).select("r.*")
    orphans = dimensions.join(associated.select(*keys), keys, "left_anti").agg(F.count("*").alias("affected"))
    return rows.unionByName(orphans.select(F.lit("orphaned dimension").alias("check_name"), "affected"))
