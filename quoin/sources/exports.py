"""Sinks: BIM rows as quoted CSV and nested JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The header of BIM tables.
BIM_COLUMNS = "ID,Type,SubType,GeometryType,StartX_mm,StartY_mm,EndX_mm,EndY_mm,Length_mm,Width_mm,Thickness_mm,Height_mm,Level,DimensionText,LengthVerified,Confidence"


def csv_line(*values: Column) -> Column:
    """All values quoted, quotes doubled, nulls empty."""
    quoted = [F.concat(F.lit('"'), F.replace(F.coalesce(v, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for v in values]
    return F.concat_ws(",", *quoted)


def bim_rows(objects: DataFrame, mm_per_pixel: float, level: str = "Level 1", keep: list[str] | None = None) -> DataFrame:
    """Objects (result_id, object_id, object_type, sub_type, x1, y1, x2, y2, dimension_text, mm, conf_pct)
    as rows of ``BIM_COLUMNS``, numbers with two decimals, after the columns that ``keep`` names."""
    two = lambda c: F.format_string("%.2f", c)
    x1, y1, x2, y2 = (F.col(c) * F.lit(mm_per_pixel) for c in ("x1", "y1", "x2", "y2"))
    length = F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))
    verified = F.coalesce(F.abs(length - F.col("mm")) <= 0.05 * F.col("mm"), F.lit(False))
    wall = F.col("object_type") == "wall"
    values = (
        F.concat_ws("-", F.col("result_id").cast("string"), F.col("object_id").cast("string")), F.col("object_type"), F.coalesce("sub_type", F.lit("")), F.lit("line"),
        two(x1), two(y1), two(x2), two(y2), two(length), F.lit(""), F.when(wall, two(F.lit(150.0))).otherwise(""), F.when(wall, two(F.lit(3000.0))).otherwise(""),
        F.lit(level), F.coalesce("dimension_text", F.lit("")), F.when(verified, "YES").otherwise("NO"), F.when(F.col("conf_pct").isNotNull(), two(F.col("conf_pct") / F.lit(100.0))).otherwise(""),
    )
    return objects.select(*(keep or []), *[v.alias(n) for v, n in zip(values, BIM_COLUMNS.split(","))])


def write_bim_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def bim_documents(rows: DataFrame, scale: str = "1:100", units: str = "mm") -> DataFrame:
    """One document for each drawing of rows (drawing_id, ``BIM_COLUMNS``): metadata, elements and statistics
    (elements in all and by type, with dimensions, with verified ones)."""
    element = F.struct(*[F.col(c) for c in rows.columns if c != "drawing_id"])
    types = rows.groupBy("drawing_id", "Type").agg(F.count("*").alias("n")).groupBy("drawing_id").agg(F.map_from_entries(F.collect_list(F.struct("Type", "n"))).alias("by_type"))
    docs = rows.groupBy("drawing_id").agg(
        F.array_sort(F.collect_list(element)).alias("elements"), F.count("*").alias("total"), F.count_if(F.col("DimensionText") != "").alias("sized"), F.count_if(F.col("LengthVerified") == "YES").alias("verified"),
    )
    statistics = F.struct(
        F.col("total").alias("total_elements"), F.col("by_type").alias("elements_by_type"), F.col("sized").alias("elements_with_dimensions"), F.col("verified").alias("elements_with_verified_dimensions"),
    )
    metadata = F.struct(F.col("total").alias("count"), F.lit(scale).alias("scale"), F.lit(units).alias("units"))
    return docs.join(types, "drawing_id").select("drawing_id", metadata.alias("metadata"), "elements", statistics.alias("statistics"))
