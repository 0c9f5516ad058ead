"""The system's readers as compositions of operators. Answers of vendors and models are input tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import boxes as b
from ..functions import geometry as g
from ..functions import parsing as p
from ..functions import text as x
from ..functions.defaults import or_default
from . import changes, matching, scaling, spatial, synthesis
from .relational import ranked

LOW = 0.85


def joined_text(boxes: DataFrame, key: str, order: list[str], text: str = "text", by: str = "\n") -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t"))))
    return boxes.groupBy(key).agg(F.array_join(F.transform(rows, lambda r: r["_t"]), by).alias("text"))


def plain_reading(boxes: DataFrame, key: str, order: str) -> DataFrame:
    """A plain reader's result: key, text (boxes' texts by lines), confidence (mean; null and 0 count as 1), n."""
    rows = F.array_sort(F.collect_list(F.struct(order, "text")))
    return boxes.groupBy(key).agg(
        F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("text"), F.avg(or_default("confidence", 1.0)).alias("confidence"), F.count("*").alias("n"),
    )


def corrected_boxes(boxes: DataFrame, corrections: DataFrame, key: str, box_id: str, default: Column | None = None) -> DataFrame:
    """Boxes whose low confidence had them read again take the new text, where there is one. ``default``
    stands for a confidence of null or 0 (left as they are without it: null is not low)."""
    sure = F.col("confidence") if default is None else F.when(F.coalesce(F.col("confidence"), F.lit(0.0)) == 0, default).otherwise(F.col("confidence"))
    low = F.coalesce(sure < LOW, F.lit(False))
    rows = boxes.join(corrections.select(key, box_id, F.col("text").alias("_new")), [key, box_id], "left")
    return rows.withColumns({"low": low, "text": F.when(low, F.coalesce("_new", "text")).otherwise(F.col("text"))}).drop("_new")


def fused_reading(boxes: DataFrame, corrections: DataFrame, key: str, box_id: str) -> DataFrame:
    """Regions read again where they were unsure, joined in reading order: key, text, n_low."""
    rows = corrected_boxes(boxes, corrections, key, box_id, F.lit(1.0))
    places = spatial.line_order(rows, key, box_id).select(key, box_id, "place")
    rows = rows.join(places, [key, box_id])
    texts = F.array_sort(F.collect_list(F.struct("place", "text")))
    return rows.groupBy(key).agg(F.array_join(F.transform(texts, lambda r: r["text"]), "\n").alias("text"), F.count_if("low").alias("n_low"))


def chosen_reading(readings: DataFrame) -> DataFrame:
    """Of a document's two whole readings (a with boxes, b without; low_share of a's boxes) one: b if more than
    30 % of the boxes are unsure, the longer if they agree by less than 70 %, else a."""
    longest = F.greatest(F.length("a"), F.length("b"))
    alike = F.when(longest > 0, (longest - x.levenshtein("a", "b")) * 100.0 / longest).otherwise(F.lit(0.0))
    rows = readings.withColumn("similarity", alike)
    why = F.when(F.col("low_share") > 30, "low confidence").when(F.col("similarity") < 70, "low agreement").otherwise("high agreement")
    longer = F.when(F.length("b") > F.length("a"), F.col("b")).otherwise(F.col("a"))
    text = F.when(F.col("low_share") > 30, F.col("b")).when(F.col("similarity") < 70, longer).otherwise(F.col("a"))
    return rows.withColumns({"why": why, "chosen": text})


def classified_confidence(confidence, corrected) -> Column:
    """0.95 where the text was corrected, else what was stated, 0.85 for nothing."""
    return F.when(corrected, F.lit(0.95)).otherwise(or_default(confidence, 0.85))


def percent_reading(answers: DataFrame, key: list[str], width: float, height: float) -> DataFrame:
    """Answers (key, answer) with coordinates in percent: key, text, boxes in pixels. An answer without a valid
    line is text alone."""
    rows = answers.withColumn("_lines", p.coordinate_lines("answer"))
    boxes = F.transform("_lines", lambda c: F.struct(c["text"].alias("text"), g.percent_box(c["left"], c["top"], c["width"], c["height"], width, height).alias("box")))
    text = F.when(F.size("_lines") > 0, F.array_join(F.transform("_lines", lambda c: c["text"]), "\n")).otherwise(F.col("answer"))
    return rows.select(*key, text.alias("text"), boxes.alias("boxes"))


def best_source(segments: DataFrame, boxes: DataFrame, key: str, segment_id: str, threshold: float = 0.65) -> DataFrame:
    """Each segment of text with the most similar box of any source; ties go to the source of the smaller
    ``priority``, then to the smaller box id. A segment without a match of ``threshold`` has null.

    boxes: key, box_id, text, priority. Pairs are those of a page whose lengths allow the threshold, and the
    edit distance stops where it would not count."""
    left = segments.where(F.trim("text") != "").select(key, segment_id, F.col("text").alias("a"))
    rows = left.join(boxes.select(key, "box_id", "priority", F.col("text").alias("b")).where("b <> ''"), key)
    n, m = F.greatest(F.length("a"), F.length("b")), F.least(F.length("a"), F.length("b"))
    most = F.floor(n * (1 - threshold) + 1e-9).cast("int")
    rows = rows.where(n - m <= most).withColumn("d", F.call_function("levenshtein", F.col("a"), F.col("b"), most)).where("d >= 0")
    rows = rows.withColumn("similarity", F.lit(1.0) - F.col("d").cast("double") / n).where(F.col("similarity") >= threshold)
    best = rows.groupBy(key, segment_id).agg(F.min(F.struct((-F.col("similarity")).alias("s"), "priority", "box_id")).alias("m"))
    out = left.join(best, [key, segment_id], "left")
    return out.select(key, segment_id, F.col("m.priority").alias("priority"), F.col("m.box_id").alias("box_id"), (-F.col("m.s")).alias("similarity"))


def validated_reading(reports: DataFrame, boxes: DataFrame, key: str, width: float, height: float) -> DataFrame:
    """Texts that a report says are missing, with a box beside the nearest known one, at the place it names:
    key, line, text, x, y, width, height, confidence."""
    missing = p.validation_entries(reports, key, "answer").where("section = 'missing'")
    at = g.phrase_position("location")
    texts = missing.select(key, "line", "text", (at["x"] * width).alias("px"), (at["y"] * height).alias("py"))
    return synthesis.synthesised(texts, boxes, key, "line", width, height)


BOX = ("text", "x", "y", "w", "h")


def self_calibrated(items: DataFrame, references: DataFrame, key: str, width: float, height: float) -> DataFrame:
    """A reader's boxes corrected by another's: boxes matched one to one teach the offsets, unmatched ones are
    placed by these. Returns key, item_id, text, x, y, width, height, source (matched takes the reference's
    place; text is the item's where they are equal, else the reference's).

    items: key, item_id, text, x, y, w, h; references: the same with ref_id."""
    return self_calibrated_pages(matching.paged(items, references, key, BOX), key, width, height)


def self_calibrated_pages(pages: DataFrame, key: str, width: float, height: float) -> DataFrame:
    """``self_calibrated`` of ``matching.pages``: what a page needs is in its row, so nothing is sent."""
    rows = matching.greedy_pages(pages)
    boxes = F.zip_with("items", "matches", lambda i, m: F.struct(i.alias("i"), F.get("refs", m["ref"]).alias("r"), m["how"].alias("how")))
    rows = rows.select(key, "refs", boxes.alias("boxes"))
    sides = lambda b: [b["i"][c].alias(c) for c in BOX[1:]] + [b["r"][c].alias(f"{c}_b") for c in BOX[1:]]
    rows = rows.withColumn("pairs", F.transform(F.filter("boxes", lambda b: b["how"].isNotNull()), lambda b: F.struct(*sides(b))))
    rows = rows.select(key, "refs", "boxes", scaling.page_calibration("pairs").alias("o"))
    one = lambda c, default: F.coalesce(c, F.lit(default))
    scale = lambda c: one(F.nullif(F.col(c), F.lit(0.0)), 1.0)
    offset = F.struct(one(F.col("o.dx"), 0.0).alias("left"), one(F.col("o.dy"), 0.0).alias("top"), scale("o.scale_x").alias("scale_x"), scale("o.scale_y").alias("scale_y"), one(F.col("o.confidence"), 0.3).alias("confidence"))
    rows = rows.select(key, "refs", offset.alias("offset"), F.explode("boxes").alias("b")).select(key, "refs", "offset", "b.i", "b.r", "b.how")
    placed = b.calibrated(*[F.col(f"i.{c}") for c in BOX[1:]], F.col("offset"), scaling.page_anchor(F.col("i"), "refs"), width, height)
    matched = F.col("how").isNotNull()
    side = lambda c, name: F.when(matched, F.col(f"r.{c}").cast("double")).otherwise(placed[name]).alias(name)
    text = F.when(matched & (F.col("how") != "exact"), F.col("r.text")).otherwise(F.col("i.text"))
    return rows.select(
        key, F.col("i.item_id").alias("item_id"), text.alias("text"), *[side(c, n) for c, n in zip(BOX[1:], ("x", "y", "width", "height"))],
        F.when(matched, F.lit("matched")).otherwise(F.lit("calibrated")).alias("source"),
    )


def last_association(points: DataFrame, objects: DataFrame, key: str, point_id: str, object_id: str, reach: float = 200.0) -> DataFrame:
    """Of the dimensions nearest to an object the last, by id: key, object id, point id, distance."""
    last = spatial.nearest(points, objects, key, point_id, object_id, reach, then=lambda rows: ranked(rows, [key, object_id], [F.desc(point_id)]))
    return last.select(key, object_id, point_id, "distance")


def bim_document_rows(objects: DataFrame, dimensions: DataFrame, key: str) -> DataFrame:
    """Drawing to BIM: dimensions (key, dim_id, text, px, py) go to their nearest objects, sizes are written back,
    the page gets its scale, missing values are imputed: objects with length, width, thickness, height,
    dimension_text, scale and n_missing.

    objects: key, object_id, object_type, sub_type, label, x1, y1, x2, y2, thickness, height."""
    found = last_association(dimensions.select(key, "dim_id", "px", "py"), objects.select(key, "object_id", "x1", "y1", "x2", "y2"), key, "dim_id", "object_id")
    texts = found.join(dimensions.select(key, "dim_id", "text"), [key, "dim_id"]).select(key, "object_id", "text", p.dimension_value("text").alias("mm"))
    bare = objects.withColumns({c: F.lit(None).cast(k) for c, k in (("length", "double"), ("width", "double"), ("dimension_text", "string"))})
    sized = changes.dimensions_written(bare, texts, [key, "object_id"])
    pixels = g.distance("x1", "y1", "x2", "y2")
    anchors = scaling.anchors(sized.select(key, "object_type", pixels.alias("pixels"), F.coalesce("length", "width").alias("mm")))
    scales = scaling.factor(anchors, [key], objects.select(key).distinct()).select(key, "scale", "n_anchors")
    full = scaling.imputed(sized.withColumn("n_missing", scaling.missing_required()), exterior=F.coalesce(F.col("sub_type") == "exterior-wall", F.lit(False)))
    return full.join(scales, key)


def detected_elements(lines: DataFrame, found: DataFrame, wall_classes: DataFrame, room_classes: DataFrame) -> DataFrame:
    """Walls and rooms of images with their classes (image_id, number, class): image_id, kind, number, class,
    confidence; unclassified walls are interior, rooms ``other``, both with 0.5."""
    number = F.row_number().over(W.partitionBy("image_id").orderBy("orientation", "at", "first")).cast("long")
    walls = lines.withColumn("number", number).select("image_id", F.lit("wall").alias("kind"), "number")
    rooms = found.select("image_id", F.lit("room").alias("kind"), F.col("room").alias("number"))

    def classed(df: DataFrame, classes: DataFrame, default: str) -> DataFrame:
        out = df.join(classes.select("image_id", "number", "class", "confidence"), ["image_id", "number"], "left")
        return out.select("image_id", "kind", "number", F.coalesce("class", F.lit(default)).alias("class"), F.coalesce("confidence", F.lit(0.5)).alias("confidence"))

    return classed(walls, wall_classes, "interior-wall").unionByName(classed(rooms, room_classes, "other"))
