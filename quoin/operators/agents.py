"""Readers that reason (agents) as functions that are passed in: rows go out as records, answers come back as
text, and what is read from an answer is repaired to fixed fields. Without a function the deterministic
operators (nearest objects, checks, greedy matching, calibration) take their place."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import enums as e
from ..functions import parsing as p
from ..functions.geometry import clamped


def consulted(rows: DataFrame, columns: list[str], call: Callable[[list[dict]], list[str | None]], answer: str = "answer") -> DataFrame:
    """``rows`` with the answer to each. ``call`` gets a batch of records of ``columns`` and returns an answer,
    or null, for each; a batch is an Arrow batch, so nothing is collected."""

    def run(batches):
        for pdf in batches:
            yield pdf.assign(**{answer: pd.Series(call(pdf[columns].to_dict("records")), dtype="object")})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{schema}, `{answer}` string")


def _field(answer, *names: str) -> Column:
    body = p.without_fence(answer)
    return F.coalesce(*[F.get_json_object(body, f"$.{n}") for n in names])


def overview(answer) -> Column:
    """What the whole-drawing agent says: title, and the scale's denominator."""
    scale = F.regexp_extract(F.coalesce(_field(answer, "scale"), F.lit("")), r"1\s*:\s*(\d+)", 1).try_cast("long")
    return F.struct(_field(answer, "title", "drawing_title").alias("title"), scale.alias("scale"))


def element(answer) -> Column:
    """An element: type, swing and room type, brought to their values."""
    return F.struct(
        _field(answer, "type", "element_type").alias("type"), e.swing(_field(answer, "swing_direction", "swingDirection")).alias("swing"), e.room_type(_field(answer, "room_type", "roomType")).alias("room"),
    )


def dimension(answer) -> Column:
    """A dimension: its text and value."""
    text = _field(answer, "text", "dimension_text", "value")
    return F.struct(text.alias("text"), p.dimension_value(text).alias("mm"))


def association(answer) -> Column:
    return F.struct(
        _field(answer, "element_id", "elementId").alias("element_id"), _field(answer, "dimension_id", "dimensionId").alias("dimension_id"), e.method(F.coalesce(_field(answer, "method", "association_method"), F.lit(""))).alias("method"),
        F.coalesce(_field(answer, "confidence").try_cast("double"), F.lit(0.5)).alias("confidence"),
    )


def verdict(answer) -> Column:
    return p.repaired_check(p.without_fence(answer))


def match(answer, least: float = 0.8) -> Column:
    """Whether two texts are one, and how sure the matcher is; below ``least`` they are not."""
    sure = F.coalesce(_field(answer, "confidence").try_cast("double"), F.lit(0.0))
    said = F.coalesce(_field(answer, "is_match", "isMatch").try_cast("boolean"), F.lit(False))
    return F.struct((said & (sure >= least)).alias("is_match"), sure.alias("confidence"))


def place(answer, width: int, height: int) -> Column:
    """A box that the coordinator returns, inside the image; null without a place."""
    number = lambda n: _field(answer, n).try_cast("double")
    box = clamped(number("x"), number("y"), number("width"), number("height"), width, height)
    return F.when(number("x").isNotNull() & number("y").isNotNull(), box)
