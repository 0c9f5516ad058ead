"""Queries on changed tables, folders, searches and small aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.defaults import js_round
from ..operators import changes as c
from ..operators import relational as r
from .registry import query

NEW = "select result_id, bbox_index + case when flag = 'R' then 100 else 0 end as bbox_index, 'correct' as status from fx_boxes where x % 3 = 0"


def _new(t):
    index = F.col("bbox_index") + F.when(F.col("flag") == "R", 100).otherwise(0)
    return t.fx_boxes.where("x % 3 = 0").select("result_id", index.alias("bbox_index"), F.lit("correct").alias("status"))


@query("m1_insert", "select drawing_id, file_name, type from fx_drawings union all select drawing_id + 1000000, concat(file_name, ' copy'), null from fx_drawings where is_confidential")
def _(t):
    new = t.fx_drawings.where("is_confidential").select((F.col("drawing_id") + 1_000_000).alias("drawing_id"), F.concat("file_name", F.lit(" copy")).alias("file_name"))
    return c.inserted(t.fx_drawings.select("drawing_id", "file_name", "type"), new)


@query("m3_upserted_checks", f"""with n as ({NEW}), ok as (select n.* from n join (select result_id, count(*) as k from fx_boxes group by result_id) s on n.result_id = s.result_id where bbox_index >= 0 and bbox_index < k)
  select result_id, bbox_index, status from ok union all select v.result_id, v.bbox_index, v.status from fx_verifications v where not exists (select 1 from ok where ok.result_id = v.result_id and ok.bbox_index = v.bbox_index)""")
def _(t):
    return c.upserted_checks(t.fx_verifications, _new(t), t.fx_boxes)[0]


@query("m3_refused_checks", f"with n as ({NEW}) select n.result_id, n.bbox_index from n left join (select result_id, count(*) as k from fx_boxes group by result_id) s on n.result_id = s.result_id where k is null or bbox_index < 0 or bbox_index >= k")
def _(t):
    return c.upserted_checks(t.fx_verifications, _new(t), t.fx_boxes)[1].select("result_id", "bbox_index")


@query("m4_update", "select result_id, case when run_id = 3 then true else success end as success, case when run_id = 3 then null else time_ms end as time_ms from fx_results")
def _(t):
    changes = t.fx_results.where("run_id = 3").select("result_id", F.lit(True).alias("success"), F.lit(None).cast("long").alias("time_ms"))
    return c.updated(t.fx_results.select("result_id", "success", "time_ms"), changes, ["result_id"])


@query("m5_written_dimensions", """select result_id, object_id, case when object_type = 'wall' and mm <> 0 then mm else x2 - x1 end as length, case when object_type in ('door', 'window') and mm <> 0 then mm else y2 - y1 end as width, case when mm <> 0 then concat(dimension_text, 'mm') else 'old' end as dimension_text
  from (select *, case when object_id % 3 = 0 then 0 when object_id % 3 = 1 then cast(dimension_text as bigint) end as mm from fx_objects)""")
def _(t):
    objects = t.fx_objects.select("result_id", "object_id", "object_type", (F.col("x2") - F.col("x1")).cast("long").alias("length"), (F.col("y2") - F.col("y1")).cast("long").alias("width"), F.lit("old").alias("dimension_text"))
    k = F.col("object_id") % 3
    mm = F.when(k == 0, F.lit(0).cast("long")).when(k == 1, F.col("dimension_text").cast("long"))
    dims = t.fx_objects.select("result_id", "object_id", F.concat("dimension_text", F.lit("mm")).alias("text"), mm.alias("mm"))
    return c.dimensions_written(objects, dims, ["result_id", "object_id"]).drop("object_type")


TREE = """with p as (select drawing_id, string_split(substr(path, 2), '/') as p, lower(path) like '%.pdf' as pdf from fx_drawings), l as (select p, pdf, unnest(range(1, len(p) + 1)) as depth from p),
  e as (select concat('/', array_to_string(p[1:depth - 1], '/')) as parent, p[depth] as name, case when depth = len(p) then 'file' else 'folder' end as kind, depth, pdf from l),
  t as (select parent, name, kind, depth, count(*) as n_files, count(*) filter (where pdf) as n_pdf from e group by all)"""


@query("s4_folder_tree", f"{TREE} select parent, name, kind, depth, n_files, n_pdf from t")
def _(t):
    return c.folder_tree(t.fx_drawings).drop("place").withColumn("depth", F.col("depth").cast("long"))


@query("o9_folders_first", f"{TREE} select parent, name, row_number() over (partition by parent order by kind = 'file', lower(name), name) as place from t")
def _(t):
    return c.folder_tree(t.fx_drawings).select("parent", "name", F.col("place").cast("long").alias("place"))


@query("a35_folder_counts", f"{TREE} select concat(case when parent = '/' then '' else parent end, '/', name) as folder, n_files, n_pdf from t where kind = 'folder'")
def _(t):
    tree = c.folder_tree(t.fx_drawings).where("kind = 'folder'")
    return tree.select(F.concat(F.when(F.col("parent") == "/", "").otherwise(F.col("parent")), F.lit("/"), "name").alias("folder"), "n_files", "n_pdf")


@query("s1_ordered_scan", "select drawing_id, file_name, type, is_confidential, path from fx_drawings order by file_name, drawing_id")
def _(t):
    return t.fx_drawings.orderBy("file_name", "drawing_id")


@query("o1_oldest_first", "select result_id, tool, created_at from fx_results order by created_at, result_id")
def _(t):
    return t.fx_results.select("result_id", "tool", "created_at").orderBy("created_at", "result_id")


@query("o7_first_references", "select drawing_id, count(*) as n, string_agg(concat(cast(rn as string), '. ', text), chr(10) order by rn) as shown from (select drawing_id, text, row_number() over (partition by drawing_id order by b.result_id, bbox_index) as rn from fx_boxes b join fx_results r on b.result_id = r.result_id) where rn <= 10 group by drawing_id")
def _(t):
    rows = t.fx_boxes.join(t.fx_results.select("result_id", "drawing_id"), "result_id")
    first = r.ranked(rows.select("drawing_id", "result_id", "bbox_index", "text"), ["drawing_id"], [F.col("result_id"), F.col("bbox_index")], 10)
    lists = first.groupBy("drawing_id").agg(F.array_sort(F.collect_list(F.struct("result_id", "bbox_index", "text"))).alias("refs"))
    shown = F.array_join(F.transform("refs", lambda b, i: F.concat((i + 1).cast("string"), F.lit(". "), b["text"])), "\n")
    return lists.select("drawing_id", F.size("refs").cast("long").alias("n"), shown.alias("shown"))


@query("p10_with_original", "select result_id, bbox_index, text, original from (select *, case when flag = 'R' then concat(text, '0') when flag = 'A' then '' end as original from fx_boxes) where original <> ''")
def _(t):
    original = F.when(F.col("flag") == "R", F.concat("text", F.lit("0"))).when(F.col("flag") == "A", "")
    return r.having_text(t.fx_boxes.select("result_id", "bbox_index", "text", original.alias("original")), "original")


@query("p12_run_search", """select run_id, run_name from fx_runs where completed and (lower(run_name) like '%0007%' or lower(description) like '%0007%' or run_id in (select r.run_id from fx_results r join fx_drawings d on r.drawing_id = d.drawing_id where lower(d.file_name) like '%0007%' or lower(r.tool) like '%0007%'))""")
def _(t):
    return r.searched_runs(t.fx_runs, t.fx_results, t.fx_drawings, "0007", "completed").select("run_id", "run_name")


@query("p15_low_words", "select result_id, count(*) filter (where conf_pct < 85) as low, count(*) filter (where conf_pct >= 85) as high, count(*) filter (where conf_pct is null) as unknown from fx_boxes group by result_id")
def _(t):
    conf = F.col("conf_pct")
    return t.fx_boxes.groupBy("result_id").agg(F.count_if(conf < 85).alias("low"), F.count_if(conf >= 85).alias("high"), F.count_if(conf.isNull()).alias("unknown"))


@query("j7_objects_of_results", "select o.result_id, r.tool, r.created_at, count(*) as n from fx_objects o join fx_results r on o.result_id = r.result_id group by all")
def _(t):
    groups = t.fx_objects.groupBy("result_id").agg(F.count("*").alias("n"))  # one row for each distinct id before the join
    return groups.join(t.fx_results.select("result_id", "tool", "created_at"), "result_id")


@query("j9_classified_rooms", """select r.result_id, r.room, coalesce(nullif(k.label, ''), 'unlabeled') as label, coalesce(k.method, 'other') as type, coalesce(nullif(k.conf_pct, 0), 50) as conf_pct from (select result_id, object_id, row_number() over (partition by result_id order by object_id) as room from fx_objects where object_type = 'room') r
  left join (select result_id, object_id, label, method, conf_pct from fx_objects where object_id % 2 = 0) k on r.result_id = k.result_id and r.object_id = k.object_id""")
def _(t):
    from pyspark.sql import Window as W

    from ..functions.defaults import or_default, text_or_default

    rooms = t.fx_objects.where("object_type = 'room'").select("result_id", "object_id", F.row_number().over(W.partitionBy("result_id").orderBy("object_id")).cast("long").alias("room"))
    known = t.fx_objects.where("object_id % 2 = 0").select("result_id", "object_id", "label", "method", "conf_pct")
    rows = rooms.join(known, ["result_id", "object_id"], "left")
    return rows.select("result_id", "room", text_or_default("label", "unlabeled").alias("label"), text_or_default("method", "other").alias("type"), or_default("conf_pct", 50).alias("conf_pct"))


@query("a11_missing_texts", "select r.result_id, count(b.result_id) as n from fx_results r left join (select result_id from fx_boxes where flag = 'N' and source = 'estimated') b on r.result_id = b.result_id group by r.result_id")
def _(t):
    entries = t.fx_boxes.where("flag = 'N' and source = 'estimated'").groupBy("result_id").agg(F.count("*").alias("n"))
    return t.fx_results.select("result_id").join(entries, "result_id", "left").na.fill(0, ["n"])


@query("a26_best_approaches", """with s as (select r.run_id, r.result_id, r.time_ms, r.cost_cents, coalesce(n, 0) as n from fx_results r left join (select result_id, count(*) as n from fx_objects group by result_id) o on r.result_id = o.result_id where success),
  k as (select *, row_number() over (partition by run_id order by n desc, result_id desc) as a, row_number() over (partition by run_id order by time_ms, result_id desc) as b, row_number() over (partition by run_id order by cost_cents, result_id desc) as c from s)
  select run_id, max(result_id) filter (where a = 1) as most_objects, max(result_id) filter (where b = 1) as fastest, max(result_id) filter (where c = 1) as cheapest from k group by run_id""")
def _(t):
    n = t.fx_objects.groupBy("result_id").agg(F.count("*").alias("n"))
    rows = t.fx_results.where("success").join(n, "result_id", "left").na.fill(0, ["n"])
    last = lambda *by: F.max_by("result_id", F.struct(*by, "result_id"))  # noqa: E731  of equals the last
    return rows.groupBy("run_id").agg(last("n").alias("most_objects"), last((-F.col("time_ms")).alias("t")).alias("fastest"), last((-F.col("cost_cents")).alias("c")).alias("cheapest"))


SIX = ("wall", "door", "window", "room", "stair", "column")


@query("a29_six_types", "select result_id, " + ", ".join(f"count(*) filter (where object_type = '{k}') as {k}s" for k in SIX) + " from fx_objects group by result_id")
def _(t):
    return t.fx_objects.groupBy("result_id").agg(*[F.count_if(F.col("object_type") == k).alias(k + "s") for k in SIX])


@query("a31_document_statistics", """select result_id, object_type, count(*) as n, count(*) filter (where dimension_text <> '' or x2 - x1 > 0) as with_dimensions, count(*) filter (where abs((x2 - x1) * 15.0 - cast(dimension_text as bigint)) <= 0.05 * cast(dimension_text as bigint)) as verified,
  count(*) filter (where sub_type is null) as defaults_applied from fx_objects group by all""")
def _(t):
    mm, drawn = F.col("dimension_text").cast("long"), (F.col("x2") - F.col("x1")) * F.lit(15.0)
    return t.fx_objects.groupBy("result_id", "object_type").agg(
        F.count("*").alias("n"), F.count_if((F.col("dimension_text") != "") | (F.col("x2") - F.col("x1") > 0)).alias("with_dimensions"),
        F.count_if(F.abs(drawn - mm) <= 0.05 * mm).alias("verified"), F.count_if(F.col("sub_type").isNull()).alias("defaults_applied"),
    )


@query("a30_quality", """with f as (select object_type, 3.0 + case when x2 - x1 > 30 then 2 else 0 end + case when dimension_text <> '' then 2 else 0 end + case when object_id % 2 = 0 then 1.5 else 0 end + case when sub_type is not null then 1.5 else 0 end + case when label <> '' then 1 else 0 end as points from fx_objects)
  select object_type, count(*) as n, floor(avg(points / 11.0 * 100) * 10000 + 0.5) / 10000 as completeness from f group by object_type union all select 'overall', count(*), floor(avg(points / 11.0 * 100) * 10000 + 0.5) / 10000 from f""")
def _(t):
    from ..operators.scaling import completeness
    from .spatial import flags

    rows = flags(t).rollup("object_type").agg(F.count("*").alias("n"), js_round(F.avg(completeness()), 4).alias("completeness"))
    return rows.withColumn("object_type", F.coalesce("object_type", F.lit("overall")))
