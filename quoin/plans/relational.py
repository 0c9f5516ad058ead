"""Queries on filters, joins, windows, ordering, sets and mutations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import defaults as d
from ..operators import relational as r
from .fixtures import spread
from .registry import query


@query("p1_lookup", "select drawing_id, file_name, type from fx_drawings where drawing_id = 42")
def _(t):
    return r.lookup(t.fx_drawings, "drawing_id", 42).select("drawing_id", "file_name", "type")


@query("p2_conjunction", "select result_id, object_id, x1, y1 from fx_objects where object_type = 'wall' and result_id % 10 = 3")
def _(t):
    return t.fx_objects.where((F.col("object_type") == "wall") & (F.col("result_id") % 10 == 3)).select("result_id", "object_id", "x1", "y1")


@query("p3_in_list", "select result_id, tool from fx_results where drawing_id in (select drawing_id from fx_drawings where type = 'BUILDING')")
def _(t):
    ids = t.fx_drawings.where("type = 'BUILDING'").select("drawing_id")
    return t.fx_results.join(ids, "drawing_id", "left_semi").select("result_id", "tool")


@query("p4_pruned", "select result_id, tool, created_at from fx_results")
def _(t):
    return t.fx_results.select("result_id", "tool", "created_at")


@query("p5_substring", "select drawing_id, file_name from fx_drawings where file_name like '%00123%' or cast(drawing_id as string) = '7'")
def _(t):
    return t.fx_drawings.where(F.contains("file_name", F.lit("00123")) | (F.col("drawing_id") == 7)).select("drawing_id", "file_name")


@query("p6_confidential", "select 'only' as mode, count(*) as n from fx_drawings where is_confidential union all select 'exclude', count(*) from fx_drawings where not is_confidential union all select 'include', count(*) from fx_drawings")
def _(t):
    parts = [r.by_confidentiality(t.fx_drawings, m).agg(F.count("*").alias("n")).select(F.lit(m).alias("mode"), "n") for m in ("only", "exclude", "include")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("p7_llm_tools", "select result_id, tool in ('1-URGENT', '2-HIGH') as uses_llm from fx_results")
def _(t):
    return t.fx_results.select("result_id", F.col("tool").isin(*r.LLM_TOOLS).alias("uses_llm"))


@query("p8_policy", "select run_id from fx_results join fx_drawings using (drawing_id) group by run_id having bool_or(is_confidential) and bool_or(tool in ('1-URGENT', '2-HIGH'))")
def _(t):
    return r.runs_breaking_policy(t.fx_results, t.fx_drawings)


@query("p9_labelled_rooms", "select result_id, object_id, label <> '' as labelled from fx_objects where object_type = 'room'")
def _(t):
    return t.fx_objects.where("object_type = 'room'").select("result_id", "object_id", (F.col("label") != "").alias("labelled"))


@query("p11_search", "select result_id, bbox_index from fx_boxes where lower(text) like '%910%' or lower(source) like '%910%'")
def _(t):
    return r.matching(t.fx_boxes, "910", "text", "source").select("result_id", "bbox_index")


@query("p13_viewer", "select result_id, bbox_index from fx_boxes where coalesce(conf_pct, 100) < 85 and coalesce(conf_pct, 100) >= 70 and flag = 'R'")
def _(t):
    c = d.nvl_default("conf_pct", 100)
    return t.fx_boxes.where((c < 85) & (c >= 70) & (F.col("flag") == "R")).select("result_id", "bbox_index")


@query("p14_low_confidence", "select result_id, bbox_index, case when conf_pct is null or conf_pct = 0 then 100 else conf_pct end < 85 as low from fx_boxes")
def _(t):
    return t.fx_boxes.select("result_id", "bbox_index", (d.or_default("conf_pct", 100) < 85).alias("low"))


@query("p16_low_lines", "select result_id, bbox_index, coalesce(conf_pct < 85, false) as low from fx_boxes")
def _(t):
    return t.fx_boxes.select("result_id", "bbox_index", F.coalesce(F.col("conf_pct") < 85, F.lit(False)).alias("low"))


@query("p22_complete_inputs", "select doc_id from fx_full where trim(truth) <> '' and trim(raw_text) <> ''")
def _(t):
    return t.texts.where((F.trim("truth") != "") & (F.trim("raw_text") != "")).select("doc_id")


@query("s7_confidential_path", "select drawing_id, regexp_matches(path, '[/\\\\]confidential(-temp-excluded)?[/\\\\]') as confidential from fx_drawings")
def _(t):
    return t.fx_drawings.select("drawing_id", F.col("path").rlike(r"[/\\]confidential(-temp-excluded)?[/\\]").alias("confidential"))


@query("s15_page_chunks", "select result_id, f as first_page, least(f + 4, page) as last_page from (select result_id, page, unnest(generate_series(1, page, 5)) as f from fx_results)")
def _(t):
    return r.chunks(t.fx_results.select("result_id", "page"), "page", 5).select("result_id", "first_page", "last_page")


@query("s16_content_key", "select doc_id, substr(md5(text), 1, 12) as cache_key from documents")
def _(t):
    return t.documents.select("doc_id", F.substring(F.md5("text"), 1, 12).alias("cache_key"))


@query("j1_run_drawings", "select run_id, count(distinct drawing_id) as n_drawings, min(file_name) as first_name, max(file_name) as last_name from fx_results join fx_drawings using (drawing_id) group by run_id")
def _(t):
    runs = t.fx_results.groupBy("run_id").agg(F.collect_set("drawing_id").alias("drawing_ids"))
    each = runs.select("run_id", F.explode("drawing_ids").alias("drawing_id")).join(t.fx_drawings.select("drawing_id", "file_name"), "drawing_id")
    return each.groupBy("run_id").agg(F.count("*").alias("n_drawings"), F.min("file_name").alias("first_name"), F.max("file_name").alias("last_name"))


@query("j2_grid", """with g as (select d.drawing_id, k.tool from (select drawing_id from fx_drawings where type = 'BUILDING') d, (select distinct tool from fx_results) k),
  f as (select *, row_number() over (partition by drawing_id, tool order by created_at, result_id) rn from fx_results)
  select g.drawing_id, g.tool, f.result_id, m.accuracy from g join f on f.drawing_id = g.drawing_id and f.tool = g.tool and rn = 1 left join fx_metrics m on m.result_id = f.result_id""")
def _(t):
    # a cell without a result is dropped, so the first results of the drawings are the grid
    drawings = t.fx_drawings.where("type = 'BUILDING'").select("drawing_id")
    first = r.first_per(t.fx_results.join(drawings, "drawing_id", "left_semi").select("drawing_id", "tool", "result_id", "created_at"), ["drawing_id", "tool"], "created_at", "result_id")
    return first.join(t.fx_metrics.select("result_id", "accuracy"), "result_id", "left").select("drawing_id", "tool", "result_id", "accuracy")


@query("j3_metrics_of_tool", "select metric_id, accuracy from fx_metrics where result_id in (select result_id from fx_results where tool = '5-LOW')")
def _(t):
    return t.fx_metrics.join(t.fx_results.where("tool = '5-LOW'"), "result_id", "left_semi").select("metric_id", "accuracy")


@query("j4_drawing_results", "select d.drawing_id, r.result_id, r.tool from fx_drawings d left join fx_results r on d.drawing_id = r.drawing_id")
def _(t):
    return t.fx_drawings.select("drawing_id").join(t.fx_results.select("drawing_id", "result_id", "tool"), "drawing_id", "left")


@query("j5_result_details", """select r.result_id, d.file_name, m.accuracy, coalesce(v.n, 0) as n_verified from fx_results r join fx_drawings d using (drawing_id)
  left join fx_metrics m on m.result_id = r.result_id left join (select result_id, count(*) n from fx_verifications group by result_id) v on v.result_id = r.result_id""")
def _(t):
    checked = t.fx_verifications.groupBy("result_id").agg(F.count("*").alias("n_verified"))
    rows = t.fx_results.join(t.fx_drawings, "drawing_id").join(t.fx_metrics.select("result_id", "accuracy"), "result_id", "left").join(checked, "result_id", "left")
    return rows.select("result_id", "file_name", "accuracy", F.coalesce("n_verified", F.lit(0)).alias("n_verified"))


@query("j6_box_status", "select b.result_id, b.bbox_index, coalesce(v.status, 'unverified') as status from fx_boxes b left join fx_verifications v using (result_id, bbox_index)")
def _(t):
    return r.with_default(t.fx_boxes.select("result_id", "bbox_index"), t.fx_verifications, ["result_id", "bbox_index"], {"status": "unverified"})


@query("j8_classified_walls", "select o.result_id, o.object_id, coalesce(c.kind, 'interior-wall') as kind, coalesce(c.conf, 50) as conf from fx_objects o left join (select l_orderkey as result_id, l_linenumber as pos, max(l_returnflag) as kind, max(l_linenumber * 10) as conf from lineitem where l_linestatus <> 'F' group by 1, 2) c on o.result_id = c.result_id and o.object_id + 1 = c.pos where o.object_type = 'wall'")
def _(t):
    kinds = t.lineitem.where("l_linestatus <> 'F'").groupBy(F.col("l_orderkey").alias("result_id"), F.col("l_linenumber").cast("long").alias("pos")).agg(F.max("l_returnflag").alias("kind"), F.max(F.col("l_linenumber") * 10).alias("conf"))
    walls = t.fx_objects.where("object_type = 'wall'").select("result_id", "object_id", (F.col("object_id") + 1).cast("long").alias("pos"))
    return r.with_default(walls, kinds, ["result_id", "pos"], {"kind": "interior-wall", "conf": 50}).drop("pos")


@query("j10_associations", "select e.result_id, e.object_id, b.bbox_index, b.text from fx_objects e join fx_boxes b on e.result_id = b.result_id and concat('elem_', cast(e.object_id as string)) = concat('elem_', cast(b.bbox_index + 1 as string)) where e.object_type = 'wall' and e.x2 > e.x1")
def _(t):
    walls = t.fx_objects.where("object_type = 'wall' and x2 > x1").select("result_id", "object_id", F.concat(F.lit("elem_"), F.col("object_id").cast("string")).alias("element"))
    texts = t.fx_boxes.select("result_id", "bbox_index", "text", F.concat(F.lit("elem_"), (F.col("bbox_index") + 1).cast("string")).alias("element"))
    return walls.join(texts, ["result_id", "element"]).select("result_id", "object_id", "bbox_index", "text")


@query("j11_dimension_texts", "select result_id, string_agg(text, ';' order by bbox_index) as texts from fx_boxes group by result_id")
def _(t):
    ordered = F.array_sort(F.collect_list(F.struct("bbox_index", "text")))
    return t.fx_boxes.groupBy("result_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), ";").alias("texts"))


@query("w1_last_per_tool", "select drawing_id, tool, result_id from (select *, row_number() over (partition by drawing_id, tool order by created_at desc, result_id desc) rn from fx_results) where rn = 1")
def _(t):
    return r.last_per(t.fx_results.select("drawing_id", "tool", "result_id", "created_at"), ["drawing_id", "tool"], "created_at", "result_id").drop("created_at")


@query("w2_first_per_tool", "select drawing_id, tool, result_id from (select *, row_number() over (partition by drawing_id, tool order by created_at, result_id) rn from fx_results) where rn = 1")
def _(t):
    return r.first_per(t.fx_results.select("drawing_id", "tool", "result_id", "created_at"), ["drawing_id", "tool"], "created_at", "result_id").drop("created_at")


@query("w4_deviation", "select result_id, floor(abs(time_ms - a) * 100.0 / a * 10000 + 0.5) / 10000 as deviation_pct from (select result_id, time_ms, avg(time_ms) over (partition by tool) a from fx_results)")
def _(t):
    mean = F.avg("time_ms").over(W.partitionBy("tool"))
    return t.fx_results.withColumn("m", mean).select("result_id", d.js_round(F.abs(F.col("time_ms") - F.col("m")) * F.lit(100.0) / F.col("m"), 4).alias("deviation_pct"))


@query("w5_normalised_time", "select tool, floor((s - lo) * 100.0 / case when hi = lo then 1 else hi - lo end * 10000 + 0.5) / 10000 as scaled from (select tool, s, min(s) over () lo, max(s) over () hi from (select tool, sum(time_ms) s from fx_results group by tool))")
def _(t):
    sums = t.fx_results.groupBy("tool").agg(F.sum("time_ms").alias("s"))  # one row a tool
    lo, hi = F.min("s").over(W.partitionBy()), F.max("s").over(W.partitionBy())
    rows = sums.select("tool", "s", lo.alias("lo"), hi.alias("hi"))
    span = F.when(F.col("hi") == F.col("lo"), F.lit(1)).otherwise(F.col("hi") - F.col("lo"))
    return rows.select("tool", d.js_round((F.col("s") - F.col("lo")) * F.lit(100.0) / span, 4).alias("scaled"))


@query("w6_numbered", "select result_id, bbox_index, concat('bbox-', cast(row_number() over (partition by result_id order by bbox_index) - 1 as string)) as name from fx_boxes")
def _(t):
    n = F.row_number().over(W.partitionBy("result_id").orderBy("bbox_index")) - 1
    return t.fx_boxes.select("result_id", "bbox_index", F.concat(F.lit("bbox-"), n.cast("string")).alias("name"))


@query("o2_latest_runs", "select run_id, started_at from (select run_id, max(created_at) as started_at from fx_results group by run_id) order by started_at desc, run_id desc limit 20")
def _(t):
    return t.fx_results.groupBy("run_id").agg(F.max("created_at").alias("started_at")).orderBy(F.desc("started_at"), F.desc("run_id")).limit(20)


@query("o6_by_confidence", "select result_id, bbox_index, conf_pct from fx_boxes where conf_pct is not null order by conf_pct desc, result_id, bbox_index limit 50")
def _(t):
    return t.fx_boxes.where("conf_pct is not null").select("result_id", "bbox_index", "conf_pct").orderBy(F.desc("conf_pct"), "result_id", "bbox_index").limit(50)


@query("u1_distinct_ids", "select distinct result_id from fx_objects")
def _(t):
    return t.fx_objects.select("result_id").distinct()


@query("u2_box_pools", "select result_id, count(*) as n, count(distinct pool) as pools from (select result_id, 'a' as pool from fx_boxes where flag = 'A' union all select result_id, 'b' from fx_boxes where flag <> 'A') group by result_id")
def _(t):
    a = t.fx_boxes.where("flag = 'A'").select("result_id", F.lit("a").alias("pool"))
    both = a.unionByName(t.fx_boxes.where("flag <> 'A'").select("result_id", F.lit("b").alias("pool")))
    return both.groupBy("result_id").agg(F.count("*").alias("n"), F.count_distinct("pool").alias("pools"))


@query("u3_missed_words", "select doc_id, len(list_filter(list_distinct(string_split(truth, ' ')), lambda x: not list_contains(string_split(raw_text, ' '), x))) as n_missed from fx_full")
def _(t):
    gone = F.array_except(F.split("truth", " "), F.split("raw_text", " "))
    return t.texts.select("doc_id", F.size(gone).cast("long").alias("n_missed"))


@query("u4_shared_characters", "select doc_id, len(list_intersect(list_distinct(string_split(truth, '')), list_distinct(string_split(raw_text, '')))) as n_shared from fx_full")
def _(t):
    from ..functions.text import chars

    return t.texts.select("doc_id", F.size(F.array_intersect(chars("truth"), chars("raw_text"))).cast("long").alias("n_shared"))


@query("u5_character_multisets", """with a as (select doc_id, c, count(*) n from (select doc_id, unnest(string_split(truth, '')) c from fx_full) group by all),
  b as (select doc_id, c, count(*) n from (select doc_id, unnest(string_split(raw_text, '')) c from fx_full) group by all)
  select doc_id, c as character, coalesce(a.n, 0) - coalesce(b.n, 0) as missing from a full outer join b using (doc_id, c) where coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def _(t):
    from ..functions.text import chars

    one = lambda c, s: spread(t.texts).select("doc_id", F.explode(chars(c)).alias("character"), F.lit(s).alias("s"))
    return one("truth", 1).unionByName(one("raw_text", -1)).groupBy("doc_id", "character").agg(F.sum("s").alias("missing")).where("missing <> 0")


@query("m2_upsert", "select drawing_id, coalesce(n.file_name, o.file_name) as file_name from (select drawing_id, file_name from fx_drawings where drawing_id % 3 <> 0) o full outer join (select drawing_id, concat(file_name, '!') as file_name from fx_drawings where drawing_id % 2 = 0) n using (drawing_id)")
def _(t):
    old = t.fx_drawings.where("drawing_id % 3 <> 0").select("drawing_id", "file_name")
    new = t.fx_drawings.where("drawing_id % 2 = 0").select("drawing_id", F.concat("file_name", F.lit("!")).alias("file_name"))
    return r.upserted(old, new, ["drawing_id"], "file_name")


@query("m8_delete", "select drawing_id from fx_drawings where drawing_id not in (select drawing_id from fx_results where success)")
def _(t):
    return r.without(t.fx_drawings.select("drawing_id"), t.fx_results.where("success"), ["drawing_id"])


@query("m9_cascade", """with gone as (select result_id from fx_results where drawing_id in (select drawing_id from fx_results where run_id = 3))
  select 'results' as kind, count(*) as n from fx_results where result_id not in (select result_id from gone) union all
  select 'metrics', count(*) from fx_metrics where result_id not in (select result_id from gone) union all
  select 'objects', count(*) from fx_objects where result_id not in (select result_id from gone)""")
def _(t):
    left = r.cascade(t.fx_results.where("run_id = 3"), t.fx_results, {"metrics": t.fx_metrics, "objects": t.fx_objects})
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, df in left.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
