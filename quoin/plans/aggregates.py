"""Queries on grouped statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import defaults as d
from ..functions import text as x
from ..operators import aggregates as a
from .fixtures import spread
from .registry import query

R4 = "floor({} * 10000 + 0.5) / 10000"
MEAN = "floor(avg({}) * 10000 + 0.5) / 10000"


def mean(v: str) -> str:
    return MEAN.format(v)


@query("a1_by_tool", f"""with r as (select tool, count(*) n_results, {mean('time_ms')} avg_time, sum(cost_cents) total_cost from fx_results where run_id = 5 group by tool),
  m as (select tool, {mean('coalesce(cer_pct, 0)')} avg_cer, {mean('accuracy')} avg_accuracy, {mean('coverage')} avg_coverage from fx_metrics join fx_results using (result_id) where run_id = 5 group by tool)
  select t.tool, coalesce(n_results, 0) n_results, coalesce(avg_time, 0) avg_time, cast(coalesce(total_cost, 0) as bigint) total_cost, coalesce(avg_cer, 0) avg_cer, coalesce(avg_accuracy, 0) avg_accuracy, coalesce(avg_coverage, 0) avg_coverage
  from (select distinct tool from fx_results) t left join r on r.tool = t.tool left join m on m.tool = t.tool""")
def _(t):
    return a.by_tool(t.fx_results.where("run_id = 5"), t.fx_metrics, t.fx_results.select("tool").distinct())


@query("a2_counts_by_run", "select run_id, tool, count(*) as n from fx_results group by run_id, tool")
def _(t):
    return t.fx_results.groupBy("run_id", "tool").agg(F.count("*").alias("n"))


@query("a3_any_confidential", "select run_id, bool_or(is_confidential) as any_confidential from fx_results join fx_drawings using (drawing_id) group by run_id")
def _(t):
    return t.fx_results.join(t.fx_drawings.select("drawing_id", "is_confidential"), "drawing_id").groupBy("run_id").agg(F.bool_or("is_confidential").alias("any_confidential"))


@query("a4_by_type", f"select object_type, count(*) as n, {mean('coalesce(conf_pct, 0)')} as avg_conf from fx_objects group by object_type")
def _(t):
    return t.fx_objects.groupBy("object_type").agg(F.count("*").alias("n"), a.mean(d.nvl_default("conf_pct", 0)).alias("avg_conf"))


@query("a5_by_sub_type", "select coalesce(sub_type, 'unknown') as sub_type, count(*) as n from fx_objects group by 1")
def _(t):
    return t.fx_objects.groupBy(d.nvl_default("sub_type", "unknown").alias("sub_type")).agg(F.count("*").alias("n"))


@query("a6_by_method", "select method, count(*) as n from fx_objects group by method")
def _(t):
    return t.fx_objects.groupBy("method").agg(F.count("*").alias("n"))


@query("a7_grouped_walls", "select coalesce(sub_type, 'unknown') as sub_type, count(*) as n, string_agg(cast(result_id as string), ',' order by result_id) as ids from fx_objects where object_type = 'wall' group by 1")
def _(t):
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("result_id")), lambda v: v.cast("string")), ",")
    return t.fx_objects.where("object_type = 'wall'").groupBy(d.nvl_default("sub_type", "unknown").alias("sub_type")).agg(F.count("*").alias("n"), ids.alias("ids"))


@query("a8_box_stats", "select result_id, count(*) as total, count(*) filter (flag = 'R') as updated, count(*) filter (coalesce(conf_pct, 100) < 85) as low, count(*) filter (source = 'ocr') as ocr from fx_boxes group by result_id")
def _(t):
    return t.fx_boxes.groupBy("result_id").agg(F.count("*").alias("total"), F.count_if(F.col("flag") == "R").alias("updated"), F.count_if(d.nvl_default("conf_pct", 100) < 85).alias("low"), F.count_if(F.col("source") == "ocr").alias("ocr"))


@query("a9_review_stats", """select *, floor(case when total > 0 then verified * 100.0 / total else 0 end * 10000 + 0.5) / 10000 as progress, floor(case when verified > 0 then correct * 100.0 / verified else 0 end * 10000 + 0.5) / 10000 as correct_rate,
  floor(case when verified > 0 then incorrect * 100.0 / verified else 0 end * 10000 + 0.5) / 10000 as incorrect_rate from (select result_id, count(*) total, count(*) filter (status = 'correct') correct, count(*) filter (status = 'incorrect') incorrect,
  count(*) filter (status = 'unverified') unverified, count(*) filter (status <> 'unverified') verified from fx_verifications group by result_id)""")
def _(t):
    return a.review_progress(t.fx_verifications, ["result_id"])


def _bins(value: str, limits: list[int]) -> str:
    out, upper = [], None
    for v in limits:
        out.append(f"count(*) filter ({value} >= {v}" + (f" and {value} < {upper})" if upper else ")") + f" as bin_{v}")
        upper = v
    return ", ".join([*out, f"count(*) filter ({value} < {limits[-1]}) as below"])


for _name, _default, _limits in (("a12_histogram", "coalesce(conf_pct, 0)", [95, 85, 75]), ("a13_histogram", "case when coalesce(conf_pct, 0) = 0 then 100 else conf_pct end", [95, 85, 75]), ("a14_histogram", "conf_pct", [95, 85, 70, 50]), ("a15_histogram", "conf_pct", [95, 85, 75, 60])):

    @query(_name, f"select source, {_bins(_default, _limits)} from fx_boxes group by source")
    def _(t, name=_name, limits=_limits):
        c = {"a12_histogram": d.nvl_default("conf_pct", 0), "a13_histogram": d.or_default("conf_pct", 100)}.get(name, F.col("conf_pct"))
        return t.fx_boxes.groupBy("source").agg(*a.histogram(c, limits))


@query("a16_histogram", f"select source, {_bins('conf_pct', [95, 85, 75, 60])}, count(*) filter (conf_pct is null) as no_confidence from fx_boxes group by source")
def _(t):
    return t.fx_boxes.groupBy("source").agg(*a.histogram(F.col("conf_pct"), [95, 85, 75, 60]), F.count_if(F.col("conf_pct").isNull()).alias("no_confidence"))


@query("a17_corrections", "select count(*) filter (c >= 85) as high, count(*) filter (c < 85) as low, count(*) filter (flag = 'R') as corrected, count(*) filter (c < 85 and flag <> 'R') as not_corrected, floor(count(*) filter (flag = 'R') * 100.0 / count(*) filter (c < 85) * 10000 + 0.5) / 10000 as rate from (select coalesce(conf_pct, 100) c, flag from fx_boxes)")
def _(t):
    c = d.nvl_default("conf_pct", 100)
    sums = t.fx_boxes.agg(F.count_if(c >= 85).alias("high"), F.count_if(c < 85).alias("low"), F.count_if(F.col("flag") == "R").alias("corrected"), F.count_if((c < 85) & (F.col("flag") != "R")).alias("not_corrected"))
    return sums.withColumn("rate", d.js_round(d.share("corrected", "low"), 4))


@query("a18_update_rates", "select tool, count(*) filter (flag = 'R') as updates, count(*) filter (coalesce(conf_pct, 100) < 85) as low, floor(count(*) filter (flag = 'R') * 100.0 / count(*) * 10000 + 0.5) / 10000 as update_rate from fx_boxes join fx_results using (result_id) group by tool")
def _(t):
    rows = t.fx_boxes.join(t.fx_results.select("result_id", "tool"), "result_id").groupBy("tool")
    sums = rows.agg(F.count_if(F.col("flag") == "R").alias("updates"), F.count_if(d.nvl_default("conf_pct", 100) < 85).alias("low"), F.count("*").alias("n"))
    return sums.withColumn("update_rate", d.js_round(d.share("updates", "n"), 4)).drop("n")


@query("a19_average_confidence", f"select result_id, {mean('case when coalesce(conf_pct, 0) = 0 then 100 else conf_pct end')} as falsy_is_one, {mean('coalesce(conf_pct, 0)')} as null_is_zero, {mean('conf_pct')} as null_is_skipped from fx_boxes group by result_id")
def _(t):
    return t.fx_boxes.groupBy("result_id").agg(a.mean(d.or_default("conf_pct", 100)).alias("falsy_is_one"), a.mean(d.nvl_default("conf_pct", 0)).alias("null_is_zero"), a.mean("conf_pct").alias("null_is_skipped"))


STATS = f"select tool, count(*) n, {mean('coalesce(cer_pct, 0)')} avg_cer, {mean('accuracy')} avg_accuracy, {mean('coverage')} avg_coverage, {mean('time_ms')} avg_time, sum(cost_cents) total_cost from fx_metrics join fx_results using (result_id) group by tool"


def _stats(t):
    rows = t.fx_metrics.join(t.fx_results.select("result_id", "tool", "time_ms", "cost_cents"), "result_id")
    return rows.groupBy("tool").agg(F.count("*").alias("n"), a.mean(d.nvl_default("cer_pct", 0)).alias("avg_cer"), a.mean("accuracy").alias("avg_accuracy"), a.mean("coverage").alias("avg_coverage"), a.mean("time_ms").alias("avg_time"), F.sum("cost_cents").alias("total_cost"))


@query("a20_tool_stats", STATS.replace("sum(cost_cents) total_cost", "cast(sum(cost_cents) as bigint) total_cost"))
def _(t):
    return _stats(t)


@query("a21_champions", f"with s as ({STATS}) select (select tool from s order by avg_accuracy desc, tool limit 1) as best_accuracy, (select tool from s order by avg_cer, tool limit 1) as best_cer, (select tool from s order by avg_time, tool limit 1) as fastest, (select tool from s order by total_cost, tool limit 1) as cheapest")
def _(t):
    return a.champions(_stats(t), {"best_accuracy": ("avg_accuracy", True), "best_cer": ("avg_cer", False), "fastest": ("avg_time", False), "cheapest": ("total_cost", False)})


@query("a22_grand_total", "select cast(sum(cost_cents) as bigint) as cost, cast(sum(time_ms) as bigint) as time_ms from fx_results")
def _(t):
    return t.fx_results.agg(F.sum("cost_cents").alias("cost"), F.sum("time_ms").alias("time_ms"))


@query("a23_processor_summary", f"""select *, floor(successes * 100.0 / files * 10000 + 0.5) / 10000 as success_rate from (select tool, count(*) files, count(*) filter (success and accuracy is not null) successes, count(*) filter (not success) failures,
  {mean('case when success then accuracy end')} avg_accuracy, min(case when success then accuracy end) min_accuracy, max(case when success then accuracy end) max_accuracy, cast(sum(case when success and accuracy is not null then cost_cents else 0 end) as bigint) total_cost,
  cast(sum(case when success and accuracy is not null then time_ms else 0 end) as bigint) total_time, cast(sum(page) as bigint) pages from fx_results left join fx_metrics using (result_id) group by tool)""")
def _(t):
    return a.processor_summary(t.fx_results.join(t.fx_metrics.select("result_id", "accuracy"), "result_id", "left"))


@query("a24_merged_chunks", """select run_id, bool_and(success) as success, coalesce(string_agg(case when success then cast(result_id as string) end, chr(10) order by result_id), '') as text, cast(sum(cost_cents) as bigint) as cost_cents, cast(sum(time_ms) as bigint) as time_ms,
  count(*) filter (not success) as failed from fx_results group by run_id""")
def _(t):
    return a.merged_chunks(t.fx_results.withColumn("text", F.col("result_id").cast("string")), ["run_id"], "result_id")


@query("a25_experiments", f"select run_id, {mean('cer_pct')} as cer, {mean('time_ms')} as time_ms, count(accuracy) as scored from fx_results left join fx_metrics using (result_id) group by run_id")
def _(t):
    return t.fx_results.join(t.fx_metrics, "result_id", "left").groupBy("run_id").agg(a.mean("cer_pct").alias("cer"), a.mean("time_ms").alias("time_ms"), F.count("accuracy").alias("scored"))


@query("a27_box_sources", "select result_id, nullif(count(*) filter (source = 'ocr'), 0) as ocr, nullif(count(*) filter (source = 'estimated'), 0) as estimated, nullif(count(*) filter (source = 'synthesized'), 0) as synthesized from fx_boxes group by result_id")
def _(t):
    return t.fx_boxes.groupBy("result_id").agg(*[F.nullif(F.count_if(F.col("source") == s), F.lit(0)).alias(s) for s in ("ocr", "estimated", "synthesized")])


@query("a28_object_pivot", "select result_id, count(*) filter (object_type = 'wall') as wall, count(*) filter (object_type = 'door') as door, count(*) filter (object_type = 'window') as window_, count(*) filter (object_type = 'room') as room from fx_objects group by result_id")
def _(t):
    p = t.fx_objects.groupBy("result_id").pivot("object_type", ["wall", "door", "window", "room"]).count().na.fill(0)
    return p.withColumnRenamed("window", "window_")


@query("a32_source_counts", "select tool, source, count(*) as n from fx_boxes join fx_results using (result_id) group by tool, source")
def _(t):
    return t.fx_boxes.select("result_id", "source").join(t.fx_results.select("result_id", "tool"), "result_id").groupBy("tool", "source").agg(F.count("*").alias("n"))


@query("a34_page_merge", f"select run_id, page, min(case when not success then result_id end) as first_error, case when bool_and(success) then {mean('time_ms')} end as avg_time from fx_results group by run_id, page")
def _(t):
    whole = F.bool_and("success")
    return t.fx_results.groupBy("run_id", "page").agg(F.min(F.when(~F.col("success"), F.col("result_id"))).alias("first_error"), F.when(whole, a.mean("time_ms")).alias("avg_time"))


@query("a36_change_counts", "select result_id, count(*) filter (op = 'add') as added, count(*) filter (op = 'modify') as modified, count(*) filter (op = 'delete') as deleted from fx_edits group by result_id")
def _(t):
    return t.fx_edits.groupBy("result_id").agg(*[F.count_if(F.col("op") == o).alias(n) for o, n in (("add", "added"), ("modify", "modified"), ("delete", "deleted"))])


@query("a37_tabs", "select count(*) filter (done) as completed, count(*) filter (not done) as in_progress from (select run_id, bool_and(success) done from fx_results group by run_id)")
def _(t):
    return t.fx_results.groupBy("run_id").agg(F.bool_and("success").alias("done")).agg(F.count_if("done").alias("completed"), F.count_if(~F.col("done")).alias("in_progress"))


LEADER = """select tool, count(*) as n, floor(avg(e) * 10000 + 0.5) / 10000 as avg_error_rate, count(*) filter (e = 0) as perfect from (select tool, case when length(truth) = 0 then case when length(raw_text) = 0 then 0 else 1 end else levenshtein(raw_text, truth) * 1.0 / length(truth) end as e
  from fx_text where strlen(truth) = length(truth) and strlen(raw_text) = length(raw_text) and doc_id % 2 = 0) group by tool"""


def _plain(t):
    return t.fx_text.where((F.octet_length("truth") == F.length("truth")) & (F.octet_length("raw_text") == F.length("raw_text")) & (F.col("doc_id") % 2 == 0))


@query("leaderboard", LEADER, {"texts": _plain})
def _(t):
    rows = spread(t.texts).select("tool", x.error_rate("raw_text", "truth").alias("e"))
    return rows.groupBy("tool").agg(F.count("*").alias("n"), a.mean("e").alias("avg_error_rate"), F.count_if(F.col("e") == 0).alias("perfect"))
