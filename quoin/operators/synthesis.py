"""Places for texts without one, and dimensions beside elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import boxes as b
from ..functions import geometry as g
from ..functions.defaults import js_round
from .spatial import by_page

CHARACTER = (20.0, 30.0)


def character_sizes(boxes: DataFrame, key: str) -> DataFrame:
    """Mean width and height of a character of each page: key, char_width, char_height."""
    rows = boxes.where(F.length("text") > 0)
    return rows.groupBy(key).agg(F.avg(F.col("w") / F.length("text")).alias("char_width"), F.avg(F.col("h").cast("double")).alias("char_height"))


def synthesised(texts: DataFrame, boxes: DataFrame, key: str, text_id: str, width: float = 1000.0, height: float = 1000.0) -> DataFrame:
    """A box for each text (key, text_id, text, px, py) beside the nearest box of its page, by centres: nearest
    to (px, py) where that is known, else to the mean of all centres. Ties go to the smaller box id.

    boxes: key, box_id, text, x, y, w, h. The nearest box is a minimum over the page's boxes (a partial
    aggregate), so pages are joined by key and nothing is sorted."""
    pages = boxes.withColumns({"cx": F.col("x") + F.col("w") / 2.0, "cy": F.col("y") + F.col("h") / 2.0})
    means = pages.groupBy(key).agg(F.avg("cx").alias("mx"), F.avg("cy").alias("my"))
    at = texts.join(means, key, "left").withColumns({"ax": F.coalesce("px", "mx"), "ay": F.coalesce("py", "my")})
    far = g.distance("ax", "ay", "cx", "cy")
    box = F.struct(F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"))
    pairs = at.select(key, text_id, "ax", "ay").join(pages.select(key, "box_id", "cx", "cy", box.alias("box")), key)
    near = pairs.groupBy(key, text_id).agg(F.min(F.struct(far.alias("far"), "box_id", "box")).alias("near"))
    rows = at.join(near, [key, text_id], "left").join(character_sizes(boxes, key), key, "left")
    made = b.beside(F.length("text"), "near.box", F.coalesce("char_width", F.lit(CHARACTER[0])), F.coalesce("char_height", F.lit(CHARACTER[1])), width, height)
    return rows.select(key, text_id, "text", made.alias("box")).select(key, text_id, "text", "box.*")


def orientation_matches(hint, x1, y1, x2, y2) -> Column:
    """Whether a line lies as ``hint`` (any, horizontal, vertical) says; null where anything goes."""
    h = F.col(hint)
    across, along = F.abs(F.col(x2) - F.col(x1)), F.abs(F.col(y2) - F.col(y1))
    return F.when(h == "horizontal", along < across).when(h == "vertical", across < along)


def associations(dimensions: DataFrame, elements: DataFrame, key: str, dimension_id: str, element_id: str, reach: float = 200.0) -> DataFrame:
    """Elements near each dimension, surest first by ``rank``: key, ids, distance, orientation_match,
    confidence (1 - (distance / reach) squared, times 1.2 up to 1 where the orientation matches).

    dimensions: key, id, px, py, hint; elements: lines x1, y1, x2, y2. Distances are rounded before they are
    held against ``reach``; grid cells are a little wider for that."""
    return by_page(dimensions, elements, key, reach + 1, lambda pairs: _sure(pairs, key, dimension_id, element_id, reach))


def _sure(pairs: DataFrame, key: str, dimension_id: str, element_id: str, reach: float) -> DataFrame:
    # a generator is not merged with what follows, so a distance is taken once and not wherever it is named
    far = F.explode(F.array(js_round(g.segment_distance("px", "py", "x1", "y1", "x2", "y2"), 2)))
    rows = pairs.withColumn("distance", far).where(F.col("distance") <= reach)
    rows = rows.withColumn("orientation_match", orientation_matches("hint", "x1", "y1", "x2", "y2")).where("hint = 'any' or orientation_match")
    share = F.col("distance") / reach
    sure = F.lit(1.0) - share * share
    sure = F.when(F.coalesce("orientation_match", F.lit(False)), F.least(F.lit(1.0), sure * 1.2)).otherwise(sure)
    rows = rows.withColumn("confidence", js_round(sure, 3))
    rank = F.row_number().over(W.partitionBy(key, dimension_id).orderBy(F.desc("confidence"), element_id))
    return rows.select(key, dimension_id, element_id, "distance", "orientation_match", "confidence", rank.alias("rank"))


def association_counts(dimensions: DataFrame, elements: DataFrame, key: str, dimension_id: str, reach: float = 200.0) -> DataFrame:
    """How many elements a dimension's page has, how many are too far, and how many lie the wrong way."""
    total = elements.groupBy(key).agg(F.count("*").alias("n"))

    def counted(pairs: DataFrame) -> DataFrame:
        rows = pairs.where(js_round(g.segment_distance("px", "py", "x1", "y1", "x2", "y2"), 2) <= reach)
        wrong = (F.col("hint") != "any") & ~orientation_matches("hint", "x1", "y1", "x2", "y2")
        return rows.groupBy(key, dimension_id).agg(F.count("*").alias("near"), F.count_if(F.coalesce(wrong, F.lit(False))).alias("wrong"))

    near = by_page(dimensions, elements, key, reach + 1, counted)
    out = dimensions.select(key, dimension_id).join(total, key, "left").join(near, [key, dimension_id], "left").na.fill(0, ["n", "near", "wrong"])
    return out.select(key, dimension_id, F.col("n").alias("total"), (F.col("n") - F.col("near")).alias("too_far"), F.col("wrong").alias("wrong_way"))
