"""Queries on reports and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records as rec
from ..operators import reports as r
from .fixtures import spread
from .registry import query

STATS = "select run_id, tool, count(*) as n, cast(sum(cost_cents) as bigint) as total_cost, max(time_ms) as longest from fx_results group by run_id, tool"


def _stats(t):
    return t.fx_results.groupBy("run_id", "tool").agg(F.count("*").alias("n"), F.sum("cost_cents").alias("total_cost"), F.max("time_ms").alias("longest"))


@query("k1_report_json", f"""with s as ({STATS}), b as (select run_id, first(tool order by total_cost, tool) as cheapest, first(tool order by longest, tool) as fastest, first(tool order by n desc, tool) as busiest from s group by run_id)
  select run_id, concat('{{"run_id":', cast(run_id as string), ',"toolStats":[', (select string_agg(concat('{{"tool":"', tool, '","n":', cast(n as string), ',"total_cost":', cast(total_cost as string), ',"longest":', cast(longest as string), '}}'), ',' order by tool) from s where s.run_id = b.run_id),
   '],"summary":{{"cheapest":"', cheapest, '","fastest":"', fastest, '","busiest":"', busiest, '"}}}}') as report from b""")
def _(t):
    best = {"cheapest": ("total_cost", False), "fastest": ("longest", False), "busiest": ("n", True)}
    return r.report_documents(_stats(t), "run_id", "tool", ["n", "total_cost", "longest"], best)


@query("k2_report_html", f"""select run_id, concat('<h1>Run ', cast(run_id as string), ' &lt;all&gt;</h1><table><tr><th>tool</th><th>n</th><th>total_cost</th></tr>', string_agg(concat('<tr><td>', tool, '</td><td>', cast(n as string), '</td><td>', cast(total_cost as string), '</td></tr>'), '' order by tool), '</table>') as html from ({STATS}) group by run_id""")
def _(t):
    return r.html_table(_stats(t), ["run_id"], ["tool"], ["tool", "n", "total_cost"], F.concat(F.lit("Run "), F.col("run_id").cast("string"), F.lit(" <all>")))


@query("k3_differences")
def _(t):
    rows = spread(t.texts.where("truth is not null")).select("doc_id", "tool", rec.character_analysis("raw_text", "truth").alias("analysis"))
    return r.difference_sections(rows, "doc_id", "tool")


@query("k4_result_html", """select result_id, concat('<h1>Result ', cast(result_id as string), '</h1><table><tr><th>bbox_index</th><th>text</th><th>conf_pct</th></tr>', string_agg(concat('<tr><td>', cast(bbox_index as string), '</td><td>', text, '</td><td>', coalesce(cast(conf_pct as string), ''), '</td></tr>'), '' order by bbox_index), '</table>') as html from fx_boxes group by result_id""")
def _(t):
    return r.html_table(t.fx_boxes, ["result_id"], ["bbox_index"], ["bbox_index", "text", "conf_pct"], F.concat(F.lit("Result "), F.col("result_id").cast("string")))


TOOLS = ["1-URGENT", "5-LOW"]


@query("k5_batch_html", """with g as (select run_id, drawing_id, max(time_ms) filter (where tool = '1-URGENT') as a, max(time_ms) filter (where tool = '5-LOW') as b from fx_results group by run_id, drawing_id)
  select run_id, concat('<h1>Batch ', cast(run_id as string), '</h1><table><tr><th>drawing_id</th><th>1-URGENT</th><th>5-LOW</th></tr>', string_agg(concat('<tr><td>', cast(drawing_id as string), '</td><td>', coalesce(cast(a as string), ''), '</td><td>', coalesce(cast(b as string), ''), '</td></tr>'), '' order by drawing_id), '</table>') as html from g group by run_id""")
def _(t):
    return r.batch_table(t.fx_results, "run_id", "drawing_id", "tool", "time_ms", TOOLS, F.concat(F.lit("Batch "), F.col("run_id").cast("string")))


@query("k8_pipeline_lines", """select concat('"elem_', cast(object_id as string), '","', object_type, '","', coalesce(sub_type, ''), '","line","', printf('%.2f', x1 * 15.0), '","', printf('%.2f', y1 * 15.0), '","', printf('%.2f', x2 * 15.0), '","', printf('%.2f', y2 * 15.0), '","', case when object_type = 'wall' then printf('%.2f', (x2 - x1) * 15.0) else '' end, '","","","","Level 1","',
  dimension_text, ';', dimension_text, 'mm","', case when conf_pct is null then '' else printf('%.2f', conf_pct / 100.0) end, '"') as line, result_id from fx_objects""")
def _(t):
    mm = lambda c: (F.col(c) * 15.0).alias(c)
    length = F.when(F.col("object_type") == "wall", (F.col("x2") - F.col("x1")) * 15.0)
    none = lambda c, k="double": F.lit(None).cast(k).alias(c)
    rows = t.fx_objects.select(
        "result_id", F.concat(F.lit("elem_"), F.col("object_id").cast("string")).alias("id"), F.col("object_type").alias("type"), "sub_type", F.lit("line").alias("geometry"), *map(mm, ("x1", "y1", "x2", "y2")), length.alias("length"),
        none("width"), none("thickness"), none("height"), none("level", "string"), F.array("dimension_text", F.concat("dimension_text", F.lit("mm"))).alias("texts"), (F.col("conf_pct") / 100.0).alias("confidence"),
    )
    return r.pipeline_lines(rows).select("line", "result_id")


def _shapes(t):
    return t.fx_objects.select("result_id", F.col("object_id").alias("id"), F.col("object_type").alias("type"), "x1", "y1", "x2", "y2", F.col("conf_pct").alias("confidence"))


@query("k9_node_documents", """select result_id, concat('{"version":"1.0.0","units":"mm","scaleFactor":15,"objects":[', string_agg(concat('{"id":', cast(object_id as string), ',"type":"', object_type, '","geometry":{"type":"line","coordinates":[{"x":', cast(x1 * 15 as string), ',"y":', cast(y1 * 15 as string), '},{"x":', cast(x2 * 15 as string), ',"y":', cast(y2 * 15 as string), '}]}',
  case when conf_pct is null then '' else concat(',"confidence":', cast(conf_pct as string)) end, '}'), ',' order by object_id), ']}') as document from fx_objects group by result_id""")
def _(t):
    return r.node_documents(_shapes(t), "result_id", 15)


@query("k10_node_scripts", """select result_id, concat('elements = []', chr(10), string_agg(concat('create_', object_type, '(', printf('%.1f', x1 * 15.0), ', ', printf('%.1f', y1 * 15.0), ', ', printf('%.1f', x2 * 15.0), ', ', printf('%.1f', y2 * 15.0), ')'), chr(10) order by object_type, object_id)) as script from fx_objects group by result_id""")
def _(t):
    return r.node_scripts(_shapes(t), "result_id", 15)


@query("k7_bim_rows", """select concat(cast(result_id as string), '-', cast(object_id as string)) as "ID", object_type as "Type", coalesce(sub_type, '') as "SubType", 'line' as "GeometryType", printf('%.2f', x1 * 15.0) as "StartX_mm", printf('%.2f', y1 * 15.0) as "StartY_mm", printf('%.2f', x2 * 15.0) as "EndX_mm", printf('%.2f', y2 * 15.0) as "EndY_mm",
  printf('%.2f', sqrt(pow((x2 - x1) * 15.0, 2) + pow((y2 - y1) * 15.0, 2))) as "Length_mm", '' as "Width_mm", case when object_type = 'wall' then '150.00' else '' end as "Thickness_mm", case when object_type = 'wall' then '3000.00' else '' end as "Height_mm", 'Level 1' as "Level", coalesce(dimension_text, '') as "DimensionText",
  case when abs(sqrt(pow((x2 - x1) * 15.0, 2) + pow((y2 - y1) * 15.0, 2)) - cast(dimension_text as bigint)) <= 0.05 * cast(dimension_text as bigint) then 'YES' else 'NO' end as "LengthVerified", case when conf_pct is null then '' else printf('%.2f', conf_pct / 100.0) end as "Confidence" from fx_objects""")
def _(t):
    from ..sources.exports import bim_rows

    return bim_rows(t.fx_objects.withColumn("mm", F.col("dimension_text").cast("long")), 15.0)


@query("k6_bim_documents", """select drawing_id, n, by_wall, with_dimensions, verified from (select r.drawing_id, count(*) as n, count(*) filter (where object_type = 'wall') as by_wall, count(*) filter (where coalesce(dimension_text, '') <> '') as with_dimensions,
  count(*) filter (where abs(sqrt(pow((x2 - x1) * 15.0, 2) + pow((y2 - y1) * 15.0, 2)) - cast(dimension_text as bigint)) <= 0.05 * cast(dimension_text as bigint)) as verified from fx_objects o join fx_results r on o.result_id = r.result_id group by r.drawing_id)""")
def _(t):
    from ..sources.exports import bim_documents, bim_rows

    rows = t.fx_objects.withColumn("mm", F.col("dimension_text").cast("long"))
    rows = bim_rows(rows, 15.0, keep=["result_id"]).join(t.fx_results.select("result_id", "drawing_id"), "result_id").drop("result_id")
    s = bim_documents(rows)
    return s.select("drawing_id", F.col("statistics.total_elements").alias("n"), F.coalesce(F.try_element_at("statistics.elements_by_type", F.lit("wall")), F.lit(0).cast("long")).alias("by_wall"), F.col("statistics.elements_with_dimensions").alias("with_dimensions"), F.col("statistics.elements_with_verified_dimensions").alias("verified"))
