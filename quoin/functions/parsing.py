"""Readers' answers to columns: coordinates, confidences, dimensions, enumerations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .defaults import leading_number
from .text import trimmed


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def coordinate_lines(answer) -> Column:
    """``TEXT|top|left|width|height`` lines (percent) as structs; lines out of range are left out."""
    lines = F.transform(F.split(_c(answer), "\n"), lambda x: F.split(trimmed(x), r"\|"))
    rows = F.transform(
        F.filter(lines, lambda p: F.size(p) >= 5),
        lambda p: F.struct(trimmed(p[0]).alias("text"), *[leading_number(p[i + 1]).alias(n) for i, n in enumerate(("top", "left", "width", "height"))]),
    )
    inside = lambda v: F.coalesce((v >= 0) & (v <= 100), F.lit(False))
    sized = lambda v: F.coalesce((v > 0) & (v <= 100), F.lit(False))
    return F.filter(rows, lambda r: inside(r["top"]) & inside(r["left"]) & sized(r["width"]) & sized(r["height"]) & (F.length(r["text"]) > 0))


def has_coordinates(answer) -> Column:
    def numeric(line):
        p = F.split(line, r"\|")
        return (F.size(p) >= 5) & F.forall(F.slice(p, 2, 4), lambda x: leading_number(x).isNotNull())

    return F.exists(F.split(_c(answer), "\n"), numeric)


# How answers state a confidence.
CONFIDENCES = (r"(?i)confidence:?\s*(\d+(?:\.\d+)?)\s*%", r"(?i)(\d+(?:\.\d+)?)\s*%\s*confident", r"(?i)accuracy:?\s*(\d+(?:\.\d+)?)\s*%")


def stated_confidence(answer) -> Column:
    """The first stated percentage of at most 100, as a share."""
    values = [F.regexp_extract(_c(answer), p, 1).try_cast("double") for p in CONFIDENCES]
    return F.coalesce(*[F.when(v <= 100, v / 100) for v in values])


def is_dimension(text) -> Column:
    return _c(text).rlike(r"""^[\d,\.]+\s*(mm|m|cm|km|ft|in|'|")?$""")


def dimension_value(text) -> Column:
    """The leading number once commas and spaces are gone."""
    return F.regexp_extract(F.regexp_replace(_c(text), r"[,\s]", ""), r"^([\d.]+)", 1).try_cast("double")


def dimension_in_units(text) -> Column:
    """Unit letters are dropped wherever they stand, without conversion."""
    return leading_number(F.regexp_replace(F.regexp_replace(_c(text), "(?i)mm|m|cm|km", ""), r"[,\s]", ""))


def dimension_before_mm(text) -> Column:
    return leading_number(F.regexp_replace(F.regexp_replace(_c(text), "(?i)mm.*", ""), ",", ""))


def first_digits(text) -> Column:
    return F.regexp_extract(_c(text), r"(\d+)", 1).try_cast("double")


def retry_seconds(message) -> Column:
    """Seconds to wait that a rate-limit message names."""
    return F.regexp_extract(_c(message), r"(?i)retry (?:in|after) (\d+(?:\.\d+)?)\s*s", 1).try_cast("double")


def without_fence(answer) -> Column:
    return trimmed(F.regexp_replace(F.regexp_replace(_c(answer), r"```(?:json)?\n?", ""), r"\n?```", ""))


def parsed(answer, schema: str) -> Column:
    """The JSON of an answer, with or without fences, as a struct; null if it is none."""
    body = without_fence(answer)
    return F.when(F.is_valid_utf8(body) & F.try_parse_json(body).isNotNull(), F.from_json(body, schema))


def _first(json, *names: str) -> Column:
    """The first of the fields that is there and not empty."""
    return F.coalesce(*[F.nullif(F.get_json_object(_c(json), f"$.{n}"), F.lit("")) for n in names])


def repaired_issue(json) -> Column:
    """An issue whose fields go by any of their names, enumerations brought to their values."""
    from .enums import category, severity

    sure = F.coalesce(F.get_json_object(_c(json), "$.confidence_in_issue"), F.get_json_object(_c(json), "$.confidence")).try_cast("double")
    return F.struct(
        severity(_first(json, "severity")).alias("severity"), category(_first(json, "category")).alias("category"),
        _first(json, "element_id", "elementId").alias("element_id"), _first(json, "dimension_id", "dimensionId").alias("dimension_id"),
        F.coalesce(_first(json, "description", "message"), F.lit("")).alias("description"), _first(json, "suggested_fix", "suggestedFix", "fix").alias("suggested_fix"),
        F.coalesce(sure, F.lit(0.8)).alias("confidence"),
    )


def repaired_check(json) -> Column:
    passed = F.coalesce(F.get_json_object(_c(json), "$.passed").try_cast("boolean"), F.lit(True))
    return F.struct(
        F.coalesce(_first(json, "check_name", "checkName", "name"), F.lit("Unknown check")).alias("check_name"), passed.alias("passed"),
        F.coalesce(_first(json, "details", "description"), F.lit("")).alias("details"), F.get_json_object(_c(json), "$.affected_count").try_cast("long").alias("affected_count"),
    )


def repaired_correction(json) -> Column:
    from .enums import correction

    return F.struct(
        correction(_first(json, "correction_type", "type")).alias("correction_type"), F.coalesce(_first(json, "target_id", "targetId"), F.lit("")).alias("target_id"),
        F.coalesce(_first(json, "field_name", "fieldName", "field"), F.lit("")).alias("field_name"), F.get_json_object(_c(json), "$.current_value").alias("current_value"),
        F.get_json_object(_c(json), "$.corrected_value").alias("corrected_value"), F.coalesce(_first(json, "reasoning", "reason"), F.lit("")).alias("reasoning"),
        F.coalesce(F.nullif(_first(json, "confidence").try_cast("double"), F.lit(0.0)), F.lit(0.5)).alias("confidence"),
    )


# Words that open a section of a report, and the forms of its entries.
MISSING, INCORRECT = "missing|not found|欠けている", "incorrect|wrong|error|間違い"
QUOTED = "[「\"']([^「\"']+)[」\"']"
FORMS = (rf"{QUOTED}.*\(.*should.*{QUOTED}", rf"{QUOTED}\s*(?:→|->)\s*{QUOTED}", rf"found\s+{QUOTED}.*should.*{QUOTED}")
LOCATION = r"(?:at|near|in|on|の)\s+([^,.)]+)"


def validation_entries(reports, key: str, answer: str):
    """Entries of validation reports, one row each: key, line, section (missing or incorrect), text,
    should_be, location. A line that opens a section is no entry; all is lower-cased."""
    from pyspark.sql import Window as W

    rows = reports.select(key, F.posexplode(F.split(F.col(answer), "\n")).alias("line", "raw")).withColumn("raw", F.lower(trimmed("raw")))
    head = F.when(F.col("raw").rlike(MISSING), "missing").when(F.col("raw").rlike(INCORRECT), "incorrect")
    rows = rows.withColumn("head", head)
    rows = rows.withColumn("section", F.last("head", ignorenulls=True).over(W.partitionBy(key).orderBy("line"))).where("head is null and raw <> '' and section is not null")
    missing = F.col("section") == "missing"
    quoted = F.regexp_extract("raw", QUOTED, 1)
    text = F.when(quoted != "", quoted).otherwise(F.trim(F.regexp_replace("raw", r"^[-*•]\s*", "")))
    side = lambda i: F.coalesce(*[F.nullif(F.regexp_extract("raw", f, i), F.lit("")) for f in FORMS])
    place = F.nullif(F.trim(F.regexp_extract("raw", LOCATION, 1)), F.lit(""))
    out = rows.select(key, "line", "section", F.when(missing, text).otherwise(side(1)).alias("text"), F.when(~missing, side(2)).alias("should_be"), place.alias("location"))
    return out.where("text <> '' and (section = 'missing' or should_be is not null)")
