"""Reports as rows: one document (JSON, HTML, script or CSV lines) for each key, made where the data is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import html_escaped
from ..sources.exports import csv_line


def _joined(item: Column, order: list, by: str = "") -> Column:
    """The items of a group as one text, in order."""
    rows = F.array_sort(F.collect_list(F.struct(*order, item.alias("_item"))))
    return F.array_join(F.transform(rows, lambda r: r["_item"]), by)


def html_table(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], title: Column) -> DataFrame:
    """keys, html: a heading and a table of each group's rows. Values are escaped; nulls are empty."""
    cells = F.concat(*[F.concat(F.lit("<td>"), F.coalesce(html_escaped(F.col(c).cast("string")), F.lit("")), F.lit("</td>")) for c in columns])
    body = _joined(F.concat(F.lit("<tr>"), cells, F.lit("</tr>")), order)
    head = "".join(f"<th>{c}</th>" for c in columns)
    out = rows.groupBy(*keys).agg(body.alias("body"))
    return out.select(*keys, F.concat(F.lit("<h1>"), html_escaped(title), F.lit(f"</h1><table><tr>{head}</tr>"), "body", F.lit("</table>")).alias("html"))


def batch_table(rows: DataFrame, key: str, file: str, processor: str, value: str, processors: list[str], title: Column) -> DataFrame:
    """key, html: a line for each file, a column for each reader."""
    grid = rows.groupBy(key, file).pivot(processor, processors).agg(F.max(value))
    return html_table(grid, [key], [file], [file, *processors], title)


def report_documents(stats: DataFrame, key: str, tool: str, measures: list[str], best: dict[str, tuple[str, bool]]) -> DataFrame:
    """key, report: JSON with the statistics of each tool and the names of the best (most or least of a measure;
    ties go to the first name; tools without a value are not considered)."""
    tools = F.array_sort(F.collect_list(F.struct(tool, *measures)))
    win = lambda m, most: F.min(F.when(F.col(m).isNotNull(), F.struct((-F.col(m) if most else F.col(m)).alias("v"), F.col(tool).alias("t"))))["t"]
    rows = stats.groupBy(key).agg(tools.alias("toolStats"), *[win(m, most).alias(n) for n, (m, most) in best.items()])
    return rows.select(key, F.to_json(F.struct(F.col(key), F.col("toolStats"), F.struct(*best).alias("summary"))).alias("report"))


def difference_sections(analyses: DataFrame, key: str, tool: str) -> DataFrame:
    """key, html: for each drawing a table of tools with the characters (analysis: missing_words,
    missing_characters, extra_characters, totals) that they miss or add, most frequent first."""
    from ..functions.records import by_count

    mark = lambda c: F.concat(F.lit("'"), html_escaped(c["character"]), F.lit("'×"), c["count"].cast("string"))
    words = F.array_join(F.transform("analysis.missing_words", lambda w: F.concat(F.lit('"'), html_escaped(w), F.lit('"'))), " ")
    many = lambda c: F.array_join(F.transform(by_count(F.col(f"analysis.{c}")), mark), " ")
    total = lambda c: F.concat(F.lit(" ("), F.col(f"analysis.{c}").cast("string"), F.lit(" total)"))
    missing = F.when(F.col("analysis.missing_total") > 0, F.concat(F.concat_ws(" ", F.nullif(words, F.lit("")), F.nullif(many("missing_characters"), F.lit(""))), total("missing_total"))).otherwise("None")
    extra = F.when(F.col("analysis.extra_total") > 0, F.concat(many("extra_characters"), total("extra_total"))).otherwise("None")
    row = F.concat(F.lit("<tr><td>"), html_escaped(tool), F.lit("</td><td>"), missing, F.lit("</td><td>"), extra, F.lit("</td></tr>"))
    out = analyses.groupBy(key).agg(_joined(row, [tool]).alias("body"))
    head = "<table><tr><th>Tool</th><th>Missing Characters</th><th>Extra Characters</th></tr>"
    return out.select(key, F.concat(F.lit("<h3>Drawing: "), F.col(key).cast("string"), F.lit(f"</h3>{head}"), "body", F.lit("</table>")).alias("html"))


#: The header of the pipeline's tables.
PIPELINE_COLUMNS = "ID,Type,SubType,GeometryType,StartX_mm,StartY_mm,EndX_mm,EndY_mm,Length_mm,Width_mm,Thickness_mm,Height_mm,Level,DimensionTexts,Confidence"


def two(value) -> Column:
    """Two decimals; empty for null."""
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    return F.when(v.isNotNull(), F.format_string("%.2f", v)).otherwise("")


def pipeline_lines(elements: DataFrame) -> DataFrame:
    """drawing key columns stay; ``line``: the element as a line of ``PIPELINE_COLUMNS``.

    elements: id, type, sub_type, geometry, x1, y1, x2, y2 (mm), length, width, thickness, height, level,
    texts (array), confidence."""
    col = lambda c, d="": F.coalesce(F.col(c).cast("string"), F.lit(d))
    values = (
        col("id"), col("type"), col("sub_type"), col("geometry"), two("x1"), two("y1"), two("x2"), two("y2"), two("length"), two("width"), two("thickness"), two("height"),
        col("level", "Level 1"), F.coalesce(F.array_join("texts", ";"), F.lit("")), two("confidence"),
    )
    return elements.withColumn("line", csv_line(*values))


def node_documents(objects: DataFrame, key: str, scale: float, units: str = "mm") -> DataFrame:
    """key, document: JSON of a drawing's objects with scaled coordinates, for the BIM host's nodes.
    objects: id, type, x1, y1, x2, y2, confidence."""
    at = lambda x, y: F.struct((F.col(x) * scale).alias("x"), (F.col(y) * scale).alias("y"))
    one = F.struct("id", "type", F.struct(F.lit("line").alias("type"), F.array(at("x1", "y1"), at("x2", "y2")).alias("coordinates")).alias("geometry"), "confidence")
    rows = objects.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("id", one.alias("o")))).alias("all"))
    body = F.struct(F.lit("1.0.0").alias("version"), F.lit(units).alias("units"), F.lit(scale).alias("scaleFactor"), F.transform("all", lambda r: r["o"]).alias("objects"))
    return rows.select(key, F.to_json(body).alias("document"))


def node_scripts(objects: DataFrame, key: str, scale: float) -> DataFrame:
    """key, script: a Python script with a call for each object, by type then id."""
    number = lambda c: F.format_string("%.1f", (F.col(c) * F.lit(scale)).cast("double"))
    call = F.concat(F.lit("create_"), "type", F.lit("("), F.concat_ws(", ", *map(number, ("x1", "y1", "x2", "y2"))), F.lit(")"))
    return objects.groupBy(key).agg(F.concat(F.lit("elements = []\n"), _joined(call, ["type", "id"], "\n")).alias("script"))
