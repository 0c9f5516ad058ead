"""Queries on readers, their costs and names, and answers' enumerations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import enums as e
from ..operators import processors as p
from .registry import query


@query("p19_compatible", """select drawing_id, count(*) filter (where not pdf or supports_pdf) as n_compatible, coalesce(string_agg(name, ',' order by name) filter (where pdf and not supports_pdf), '') as skipped,
  coalesce(string_agg(name, ',' order by name) filter (where pdf and supports_pdf and page_count > max_pages), '') as to_split, min(max_pages) filter (where pdf and supports_pdf and page_count > max_pages) as page_limit
  from (select distinct j.drawing_id, j.page_count, p.name, p.supports_pdf, p.max_pages, lower(d.path) like '%.pdf' as pdf from fx_jobs j join fx_processors p on j.processor_id = p.processor_id join fx_drawings d on j.drawing_id = d.drawing_id)
  group by drawing_id having count(*) filter (where not pdf or supports_pdf) > 0""")
def _(t):
    return p.compatible(t.fx_jobs.join(t.fx_drawings.select("drawing_id", "path"), "drawing_id"), t.fx_processors)


EITHER = {"vision": [["vision_account", "vision_project"], ["vision_key"]]}
KEYS = """with c as (select key_name from fx_configured where trim(value) <> ''), k as (select distinct processor_id, key_name, key_name in (select key_name from c) as own,
  case when key_name = 'vision' then (select count(*) from c where key_name in ('vision_account', 'vision_project')) = 2 or (select count(*) from c where key_name = 'vision_key') > 0 else key_name in (select key_name from c) end as ok from fx_keys)"""


@query("p20_available", f"{KEYS} select processor_id, bool_and(ok) as available from k group by processor_id")
def _(t):
    return p.availability(t.fx_keys, t.fx_configured, EITHER).select("processor_id", "available")


@query("u6_missing_keys", f"{KEYS} select processor_id, coalesce(string_agg(key_name, ',' order by key_name) filter (where not own), '') as missing from k group by processor_id having not bool_and(ok)")
def _(t):
    return p.availability(t.fx_keys, t.fx_configured, EITHER).where("not available").select("processor_id", "missing")


@query("p21_categories", "select category, count(*) as n, count(*) filter (where confidential_safe) as n_safe, coalesce(string_agg(name, ',' order by name) filter (where confidential_safe), '') as safe from fx_processors group by category")
def _(t):
    return p.by_category(t.fx_processors)


@query("a33_cost_estimate", """with p as (select processor_id, cast(regexp_extract(cost, '([0-9.]+)', 1) as double) as lo, try_cast(nullif(regexp_extract(cost, '([0-9.]+)-([0-9.]+)', 2), '') as double) as hi from fx_processors),
  r as (select run_id, count(distinct drawing_id) as images from fx_results group by run_id)
  select j.run_id, floor(sum(lo) * images * 100 + 0.5) / 100 as lowest, floor(sum(coalesce(hi, lo)) * images * 100 + 0.5) / 100 as highest from (select distinct run_id, result_id % 25 as processor_id from fx_results) j join p on j.processor_id = p.processor_id join r on j.run_id = r.run_id group by j.run_id, images""")
def _(t):
    runs = t.fx_results.select("run_id", (F.col("result_id") % 25).alias("processor_id"))
    images = t.fx_results.groupBy("run_id").agg(F.count_distinct("drawing_id").alias("images"))
    return p.run_costs(runs, images, t.fx_processors, "run_id")


NAMED = "select distinct concat(tool, case result_id % 6 when 1 then '-cloud-vision' when 2 then '-azure-layout' when 3 then '-gemini-bbox' when 4 then '--x-y-z' when 5 then '-azure-read-gemini' else '' end) as name from fx_results"


@query("f37_abbreviations", f"""select name, case when name like '%gemini%' and name like '%bbox%' then 'GB' when name like '%cloud%' and name like '%vision%' then 'CV' when name like '%azure%' and name like '%read%' then 'AR' when name like '%azure%' and name like '%layout%' then 'AL'
  else array_to_string(list_transform(list_filter(string_split(name, '-'), lambda p: p <> '')[1:3], lambda p: upper(p[1])), '') end as short from ({NAMED})""")
def _(t):
    k = F.col("result_id") % 6
    ending = F.when(k == 1, "-cloud-vision").when(k == 2, "-azure-layout").when(k == 3, "-gemini-bbox").when(k == 4, "--x-y-z").when(k == 5, "-azure-read-gemini").otherwise("")
    return t.fx_results.select(F.concat("tool", ending).alias("name")).distinct().select("name", e.abbreviation("name").alias("short"))


@query("f47_display_labels", "select processor_id, concat(name, case when recommended then ' (Recommended)' else '' end, case when experimental then ' (Experimental)' else '' end) as label from fx_processors")
def _(t):
    return t.fx_processors.select("processor_id", e.display_label("name", "recommended", "experimental").alias("label"))


@query("f40_costs", """select result_id, floor(case result_id % 10 when 0 then 0.15 * page when 1 then 0.225 * page when 2 then 1.5 * page when 3 then 0.225 * page when 4 then 0.05 * page when 5 then 0.02 * page when 6 then 1.5 * page when 7 then 1.0 * page
  when 8 then 0.21 + 0.02 * page else 0 end * 10000 + 0.5) / 10000 as cost from fx_results""")
def _(t):
    from ..functions.defaults import js_round

    kinds = F.array(*[F.lit(k) for k in [*e.RATES, "calibrated", "none"]])
    kind = F.get(kinds, (F.col("result_id") % 10).cast("int"))
    return t.fx_results.select("result_id", js_round(e.estimated_cost(kind, F.col("page")), 4).alias("cost"))


@query("f45_times", "select result_id, strftime(cast(created_at as timestamp) + to_hours(cast(result_id % 24 as int)), '%b %-d, %Y, %-I:%M %p') as shown from fx_results")
def _(t):
    at = F.col("created_at").cast("timestamp_ntz") + F.make_interval(hours=(F.col("result_id") % 24).cast("int"))
    return t.fx_results.select("result_id", e.shown_time(at).alias("shown"))


@query("q6_queue_eta", "select drawing_id, count(*) as waiting, cast(case when count(*) = 0 then 0 else ceil(count(*) / 2.0) * 2000 + (ceil(count(*) / 2.0) - 1) * 2000 end as bigint) as eta_ms from fx_results where not success group by drawing_id")
def _(t):
    rows = t.fx_results.where("not success").groupBy("drawing_id").agg(F.count("*").alias("waiting"))
    return rows.select("drawing_id", "waiting", e.queue_eta("waiting").alias("eta_ms"))


WORDS = ["Left", "UP", "Kitchen", "porch", "Error", "fatal", "Spatial Proximity, other", "leaderlinealignment x", "Math check", "scale error", "Data Completeness", "odd", "Coordinate", "Dimension Value", "GOOD", ""]


@query("f29_enums", """with w as (select p_partkey, case p_partkey % 16 when 0 then 'Left' when 1 then 'UP' when 2 then 'Kitchen' when 3 then 'porch' when 4 then 'Error' when 5 then 'fatal' when 6 then 'Spatial Proximity, other' when 7 then 'leaderlinealignment x' when 8 then 'Math check'
   when 9 then 'scale error' when 10 then 'Data Completeness' when 11 then 'odd' when 12 then 'Coordinate' when 13 then 'Dimension Value' when 14 then 'GOOD' else '' end as w from part), l as (select p_partkey, w, lower(w) as x from w)
  select p_partkey, case when w = '' then null when x in ('left', 'right', 'both', 'none') then x else 'unknown' end as swing, case when w = '' then null when x = 'kitchen' then x else 'unknown' end as room, case when x = 'error' then x else 'info' end as severity,
   case x when 'spatial proximity, other' then 'spatial_proximity' else 'contextual_inference' end as method_, case x when 'math check' then 'mathematical_inconsistency' when 'scale error' then 'scale_error' when 'data completeness' then 'missing_data' when 'dimension value' then 'dimension_mismatch' else 'other' end as category,
   case x when 'coordinate' then x when 'dimension value' then 'dimension_value' else 'property' end as correction, case when x = 'good' then x else 'acceptable' end as grade from l where x not like 'leaderline%'
  union all select p_partkey, 'unknown', 'unknown', 'info', 'leader_line_alignment', 'other', 'property', 'acceptable' from l where x like 'leaderline%'""")
def _(t):
    w = F.get(F.array(*map(F.lit, WORDS)), (F.col("p_partkey") % 16).cast("int"))
    rows = t.part.select("p_partkey", w.alias("w"))
    kinds = {"swing": e.swing, "room": e.room_type, "severity": e.severity, "method_": e.method, "category": e.category, "correction": e.correction, "grade": e.grade}
    return rows.select("p_partkey", *[f("w").alias(n) for n, f in kinds.items()])


@query("f30_repaired_issues", """select p_partkey, case when p_partkey % 3 = 0 then 'error' else 'info' end as severity, case when p_partkey % 2 = 0 then 'scale_error' else 'other' end as category, case when p_partkey % 3 = 0 then p_brand when p_partkey % 3 = 1 then p_name end as element_id, p_type as description,
  case when p_partkey % 4 = 0 then 0.25 when p_partkey % 4 = 1 then 0.5 else 0.8 end as confidence from part""")
def _(t):
    from ..functions.parsing import repaired_issue, without_fence

    q = lambda k, v: F.concat(F.lit(f'"{k}": "'), v, F.lit('"'))
    k = F.col("p_partkey")
    fields = F.array_compact(F.array(
        F.when(k % 3 == 0, q("severity", F.lit("ERROR"))), F.when(k % 2 == 0, q("category", F.lit("Scaling trouble"))), F.when(k % 3 == 0, q("element_id", F.col("p_brand"))).when(k % 3 == 1, q("elementId", F.col("p_name"))),
        F.when(k % 5 == 0, q("message", F.col("p_type"))).otherwise(q("description", F.col("p_type"))), F.when(k % 4 == 0, F.lit('"confidence_in_issue": 0.25')).when(k % 4 == 1, F.lit('"confidence": 0.5')),
    ))
    answer = F.concat(F.lit("```json\n{"), F.array_join(fields, ", "), F.lit("}\n```"))
    i = repaired_issue(without_fence(answer))
    return t.part.select("p_partkey", *[i[c].alias(c) for c in ("severity", "category", "element_id", "description", "confidence")])


@query("f31_parsed_json", "select p_partkey, p_brand as label, p_size * 2 as size, p_partkey % 3 > 0 as parsed from part where p_partkey % 3 > 0 union all select p_partkey, null, null, false from part where p_partkey % 3 = 0")
def _(t):
    from ..functions.parsing import parsed

    body = F.concat(F.lit('{"label": "'), F.col("p_brand"), F.lit('", "size": '), (F.col("p_size") * 2).cast("string"), F.when(F.col("p_partkey") % 3 == 0, F.lit("")).otherwise(F.lit("}")))
    answer = F.concat(F.when(F.col("p_partkey") % 3 == 1, F.lit("```json\n")).otherwise(F.lit("```\n")), body, F.lit("\n```"))
    rows = t.part.select("p_partkey", parsed(answer, "label string, size int").alias("j"))
    return rows.select("p_partkey", "j.label", "j.size", F.col("j").isNotNull().alias("parsed"))


@query("f12_validation", """with l as (select report_id, i, string_split(lower(answer), chr(10))[i] as line from (select report_id, answer, unnest(range(1, len(string_split(answer, chr(10))) + 1)) as i from fx_reports)),
  h as (select *, case when line like '%missing%' or line like '%not found%' then 'missing' when line like '%incorrect%' or line like '%wrong%' or line like '%error%' then 'incorrect' end as head from l),
  s as (select *, last_value(head ignore nulls) over (partition by report_id order by i) as section, regexp_extract(line, '(?:at|near|in|on|の)\\s+([^,.)]+)', 1) as place from h),
  f as (select *, trim(place) as location, coalesce(nullif(regexp_extract(line, '\\"([^\\"]+)\\"', 1), ''), trim(regexp_replace(line, '^[-*•]\\s*', ''))) as text from s where head is null and line <> '')
  select report_id, cast(i - 1 as bigint) as line, 'missing' as section, text, null as should_be, nullif(location, '') as location from f where section = 'missing' and text <> ''
  union all select report_id, cast(i - 1 as bigint), 'incorrect', a, b, nullif(location, '') from (select *, case when line like '%(%should%' then regexp_extract(line, '\\"([^\\"]+)\\".*\\(.*should.*\\"([^\\"]+)\\"', 1) when line like '%->%' then regexp_extract(line, '\\"([^\\"]+)\\"\\s*->', 1) else regexp_extract(line, 'found\\s+\\"([^\\"]+)\\"', 1) end as a,
    case when line like '%->%' then regexp_extract(line, '->\\s*\\"([^\\"]+)\\"', 1) else regexp_extract(line, 'should.*\\"([^\\"]+)\\"', 1) end as b from f where section = 'incorrect') where a <> '' and b <> ''""")
def _(t):
    from ..functions.parsing import validation_entries

    return validation_entries(t.fx_reports, "report_id", "answer").select("report_id", F.col("line").cast("long").alias("line"), "section", "text", "should_be", "location")
