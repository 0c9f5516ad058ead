"""Queries on geometry, nearest and overlap joins, scaling and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import defaults as d
from ..functions import geometry as g
from ..functions import parsing as p
from ..operators import scaling as c
from ..operators import spatial as s
from .registry import query

R4 = "floor(({}) * 10000 + 0.5) / 10000"
MID = "sqrt(pow(b.x - (o.x1 + o.x2) / 2.0, 2) + pow(b.y - (o.y1 + o.y2) / 2.0, 2))"


def _points(t):
    return t.fx_boxes.select("result_id", "bbox_index", F.col("x").alias("px"), F.col("y").alias("py"))


def _objects(t, kind=None):
    o = t.fx_objects.select("result_id", "object_id", "object_type", "x1", "y1", "x2", "y2")
    return (o.where(F.col("object_type") == kind) if kind else o).drop("object_type")


@query("j12_nearest_object", f"select result_id, bbox_index, object_id, {R4.format('dist')} as distance from (select b.result_id, b.bbox_index, o.object_id, {MID} dist, row_number() over (partition by b.result_id, b.bbox_index order by {MID}, o.object_id) rn from fx_boxes b join fx_objects o on b.result_id = o.result_id and o.object_type = 'room' where {MID} < 200) where rn = 1")
def _(t):
    rows = s.nearest(_points(t), _objects(t, "room"), "result_id", "bbox_index", "object_id", 200.0)
    return rows.select("result_id", "bbox_index", "object_id", d.js_round("distance", 4).alias("distance"))


@query("j13_three_nearest", f"select result_id, bbox_index, object_id, rn as rank from (select b.result_id, b.bbox_index, o.object_id, row_number() over (partition by b.result_id, b.bbox_index order by {MID}, o.object_id) rn from fx_boxes b join fx_objects o on b.result_id = o.result_id where {MID} < 400) where rn <= 3")
def _(t):
    return s.nearest(_points(t), _objects(t), "result_id", "bbox_index", "object_id", 400.0, 3).select("result_id", "bbox_index", "object_id", F.col("rank").cast("long").alias("rank"))


SEG = "sqrt(pow(b.x - (o.x1 + u * (o.x2 - o.x1)), 2) + pow(b.y - (o.y1 + u * (o.y2 - o.y1)), 2))"


@query("g33_nearest_wall", f"""select result_id, bbox_index, object_id, {R4.format('dist')} as distance from (select *, row_number() over (partition by result_id, bbox_index order by dist, object_id) rn from (
  select b.result_id, b.bbox_index, o.object_id, {SEG} as dist from fx_boxes b join (select * from fx_objects where object_type = 'wall') o on b.result_id = o.result_id,
  lateral (select greatest(0.0, least(1.0, ((b.x - o.x1) * (o.x2 - o.x1) + (b.y - o.y1) * (o.y2 - o.y1)) * 1.0 / (pow(o.x2 - o.x1, 2) + pow(o.y2 - o.y1, 2)))) as u)) where dist < 300) where rn = 1""")
def _(t):
    rows = s.nearest(_points(t), _objects(t, "wall"), "result_id", "bbox_index", "object_id", 300.0, segments=True)
    return rows.select("result_id", "bbox_index", "object_id", d.js_round("distance", 4).alias("distance"))


@query("j16_overlaps", "select a.result_id, a.bbox_index, b.bbox_index as other from fx_boxes a join fx_boxes b on a.result_id = b.result_id and a.bbox_index < b.bbox_index and a.x <= b.x + b.w and b.x <= a.x + a.w and a.y <= b.y + b.h and b.y <= a.y + a.h")
def _(t):
    a = t.fx_boxes.select("result_id", "bbox_index", "x", "y", "w", "h")
    b = a.select("result_id", F.col("bbox_index").alias("other"), *[F.col(v).alias(f"{v}_b") for v in "xywh"])
    return s.overlapping(a, b, "result_id").where("bbox_index < other").select("result_id", "bbox_index", "other")


@query("g1_distance", f"select result_id, object_id, {R4.format('sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2))')} as length from fx_objects")
def _(t):
    return t.fx_objects.select("result_id", "object_id", d.js_round(g.distance("x1", "y1", "x2", "y2"), 4).alias("length"))


@query("g2_centres", "select result_id, bbox_index, x + w / 2.0 as cx, y + h / 2.0 as cy from fx_boxes")
def _(t):
    m = g.centre(g.rectangle("x", "y", "w", "h"))
    return t.fx_boxes.select("result_id", "bbox_index", m["x"].alias("cx"), m["y"].alias("cy"))


@query("g5_bounds", "select result_id, bbox_index, cast(x as double) as x, cast(y as double) as y, cast(w as double) as width, cast(h as double) as height from fx_boxes")
def _(t):
    b = g.bounds(g.rectangle("x", "y", "w", "h"))
    return t.fx_boxes.select("result_id", "bbox_index", *[b[v].alias(v) for v in ("x", "y", "width", "height")])


@query("g6_padding", "select result_id, bbox_index, greatest(0, x - 10) * 1.0 as px, greatest(0, y - 10) * 1.0 as py, least(1000 - x, w + 20) * 1.0 as pw, least(800 - y, h + 20) * 1.0 as ph from fx_boxes")
def _(t):
    b = g.padded("x", "y", "w", "h", 10, 1000.0, 800.0)
    return t.fx_boxes.select("result_id", "bbox_index", *[b[v].cast("double").alias(n) for v, n in (("x", "px"), ("y", "py"), ("width", "pw"), ("height", "ph"))])


@query("g9_iou", f"""select result_id, bbox_index, {R4.format('i * 1.0 / (w * h + w2 * h2 - i)')} as iou from (select *, greatest(0, least(x + w, x2 + w2) - greatest(x, x2)) * greatest(0, least(y + h, y2 + h2) - greatest(y, y2)) as i
  from (select result_id, bbox_index, x, y, w, h, x + 5 as x2, y + 3 as y2, w - 2 as w2, h + 4 as h2 from fx_boxes))""")
def _(t):
    a, b = g.bounds(g.rectangle("x", "y", "w", "h")), g.bounds(g.rectangle(F.col("x") + 5, F.col("y") + 3, F.col("w") - 2, F.col("h") + 4))
    return t.fx_boxes.select("result_id", "bbox_index", d.js_round(g.intersection_over_union(a, b), 4).alias("iou"))


@query("g11_inside", "select result_id, bbox_index, 500 >= x and 500 < x + w * 20 and 400 >= y and 400 < y + h * 20 as inside from fx_boxes")
def _(t):
    box = g.rectangle("x", "y", F.col("w") * 20, F.col("h") * 20)
    return t.fx_boxes.select("result_id", "bbox_index", g.inside(F.lit(500.0), F.lit(400.0), box).alias("inside"))


@query("g12_topmost", "select result_id, max(bbox_index) as bbox_index from fx_boxes where 500 >= x and 500 < x + w * 20 and 400 >= y and 400 < y + h * 20 group by result_id")
def _(t):
    box = g.rectangle("x", "y", F.col("w") * 20, F.col("h") * 20)
    return t.fx_boxes.where(g.inside(F.lit(500.0), F.lit(400.0), box)).groupBy("result_id").agg(F.max("bbox_index").alias("bbox_index"))


@query("g14_percent_boxes", "select result_id, bbox_index, floor(x / 1000.0 * 640 * 10000 + 0.5) / 10000 as px, floor(y / 800.0 * 480 * 10000 + 0.5) / 10000 as py from fx_boxes")
def _(t):
    b = g.percent_box(F.col("x") / 10.0, F.col("y") / 8.0, "w", "h", 640, 480)
    return t.fx_boxes.select("result_id", "bbox_index", d.js_round(b["x"], 4).alias("px"), d.js_round(b["y"], 4).alias("py"))


@query("g16_perimeter", "select result_id, bbox_index, 2.0 * (w + h) as around from fx_boxes")
def _(t):
    return t.fx_boxes.select("result_id", "bbox_index", g.pixel_length(F.lit("polygon"), g.rectangle("x", "y", "w", "h")).alias("around"))


@query("g21_feet", f"select result_id, object_id, {R4.format('x1 * 15.0 / 304.8')} as fx, {R4.format('(800 - y1) * 15.0 / 304.8')} as fy from fx_objects")
def _(t):
    pts = g.feet(F.array(g.point("x1", "y1")), 15.0, 800.0)
    return t.fx_objects.select("result_id", "object_id", d.js_round(pts[0]["x"], 4).alias("fx"), d.js_round(pts[0]["y"], 4).alias("fy"))


@query("g22_verified_length", "select result_id, object_id, abs((x2 - x1) * 455.0 - v) <= 0.05 * v as verified from (select result_id, object_id, x1, x2, cast(dimension_text as double) v from fx_objects)")
def _(t):
    rows = t.fx_objects.withColumns({"length": (F.col("x2") - F.col("x1")) * F.lit(455.0), "expected": p.dimension_in_units("dimension_text")})
    return rows.select("result_id", "object_id", c.verified_length("length", "expected").alias("verified"))


@query("g26_relation", """select result_id, object_id, case when abs(x2 - 500) > abs(y2 - 400) then concat(cast(abs(x2 - 500) as string), case when x2 > 500 then 'px right' else 'px left' end)
  else concat(cast(abs(y2 - 400) as string), case when y2 > 400 then 'px below' else 'px above' end) end as relation from fx_objects""")
def _(t):
    return t.fx_objects.select("result_id", "object_id", g.relation(F.lit(500), F.lit(400), "x2", "y2").alias("relation"))


@query("g28_character_size", "select result_id, floor(avg(w * 1.0 / length(text)) * 1000000 + 0.5) / 1000000 as avg_width, list_sort(list(h))[count(*) // 2 + 1] as upper_median_height from fx_boxes group by result_id")
def _(t):
    upper = F.element_at(F.array_sort(F.collect_list("h")), (F.floor(F.count("*") / 2) + 1).cast("int"))
    return t.fx_boxes.groupBy("result_id").agg(d.js_round(F.avg(F.col("w") / F.length("text")), 6).alias("avg_width"), upper.alias("upper_median_height"))


@query("g31_columns", "select i as column_index, case when i < 26 then chr(65 + cast(i as int)) else concat(chr(64 + cast(i // 26 as int)), chr(65 + cast(i % 26 as int))) end as label, i as back from (select distinct l_partkey % 600 as i from lineitem)")
def _(t):
    rows = t.lineitem.select((F.col("l_partkey") % 600).alias("column_index")).distinct()
    rows = rows.withColumn("label", g.column_label("column_index"))
    return rows.withColumn("back", g.column_index("label").cast("long"))


@query("g34_wall_rows", f"select result_id, object_id, {R4.format('x1 / 304.8')} as x_ft, {R4.format('3000 / 304.8')} as height_ft, coalesce(sub_type, 'interior') as kind from fx_objects where object_type = 'wall'")
def _(t):
    rows = t.fx_objects.where("object_type = 'wall'")
    return rows.select("result_id", "object_id", d.js_round(F.col("x1") / 304.8, 4).alias("x_ft"), d.js_round(F.lit(3000.0) / 304.8, 4).alias("height_ft"), d.nvl_default("sub_type", "interior").alias("kind"))


@query("g35_clamped", "select result_id, bbox_index, greatest(0, least(x + 300, 1000 - w)) * 1.0 as cx, greatest(0, least(y + 300, 800 - h)) * 1.0 as cy, greatest(10, w) * 1.0 as cw, greatest(10, h) * 1.0 as ch from fx_boxes")
def _(t):
    b = g.clamped(F.col("x") + 300, F.col("y") + 300, "w", "h", 1000, 800)
    return t.fx_boxes.select("result_id", "bbox_index", *[b[v].alias(n) for v, n in (("x", "cx"), ("y", "cy"), ("width", "cw"), ("height", "ch"))])


ANCHORS = """a as (select result_id, mm * 1.0 / px as f, least(1.0, case when object_type = 'wall' then 0.9 when object_type in ('door', 'window') then 0.7 else 0.5 end + case when px > 500 then 0.1 else 0.0 end + case when px > 700 then 0.1 else 0.0 end) as c
  from (select result_id, object_type, sqrt(pow(x2 - x1, 2) + pow((y2 - y1) * 40, 2)) as px, cast(dimension_text as double) as mm from fx_objects) where px >= 10 and mm >= 100)"""


def _anchors(t):
    rows = t.fx_objects.select("result_id", "object_type", g.distance("x1", F.lit(0), "x2", (F.col("y2") - F.col("y1")) * 40).alias("pixels"), p.dimension_in_units("dimension_text").alias("mm"))
    return c.anchors(rows)


@query("g17_anchors", f"with {ANCHORS} select result_id, count(*) as n, floor(sum(f) * 10000 + 0.5) / 10000 as total, floor(min(c) * 10 + 0.5) / 10 as least from a group by result_id")
def _(t):
    return _anchors(t).groupBy("result_id").agg(F.count("*").alias("n"), d.js_round(F.sum("factor"), 4).alias("total"), d.js_round(F.min("confidence"), 1).alias("least"))


@query("g18_scale", f"""with {ANCHORS}, s as (select result_id, sum(f * c) / sum(c) w, count(*) n, stddev_pop(f) sd, min(f) lo, max(f) hi, min(c) lc from a group by result_id)
  select r.result_id, floor(coalesce(w, 15.0) * 10000 + 0.5) / 10000 as scale, coalesce(n, 0) as n_anchors, floor(coalesce(sd, 0) * 10000 + 0.5) / 10000 as spread, floor(coalesce(greatest(hi - w, w - lo) / w * 100, 0) * 10000 + 0.5) / 10000 as max_deviation,
  floor(case when n is null then 0 else least(1.0, lc + case when n >= 3 then 0.1 else 0.0 end + case when greatest(hi - w, w - lo) / w * 100 < 5 then 0.1 else 0.0 end) end * 10000 + 0.5) / 10000 as confidence from (select result_id from fx_results) r left join s using (result_id)""")
def _(t):
    return c.factor(_anchors(t), ["result_id"], t.fx_results.select("result_id"))


@query("g19_robust_scale", f"""with {ANCHORS}, s as (select result_id, count(*) n, avg(f) m, median(f) med, stddev_pop(f) sd, sum(f * c) / sum(c) w from a group by result_id)
  select result_id, n, floor(case when sd / m * 100 > 20 then med else w end * 1000 + 0.5) / 1000 as scale, case when sd / m * 100 > 20 then 'median' else 'weighted_average' end as method,
  floor(sd * 1000 + 0.5) / 1000 as sd from s""")
def _(t):
    return c.robust_factor(_anchors(t), ["result_id"]).drop("confidence")


@query("g23_calibration", """select result_id, floor(avg(x - xb) * 10000 + 0.5) / 10000 as dx, floor(avg(y - yb) * 10000 + 0.5) / 10000 as dy, floor(avg(case when wb > 0 then w * 1.0 / wb else 0 end) * 10000 + 0.5) / 10000 as scale_x, floor(avg(case when hb > 0 then h * 1.0 / hb else 0 end) * 10000 + 0.5) / 10000 as scale_y,
  floor(greatest(0.3, least(0.9, 1 - stddev_pop(y - yb) / 100)) * 10000 + 0.5) / 10000 as confidence, count(*) as n from (select *, x + partkey % 7 as xb, y - partkey % 13 as yb, w - 20 as wb, h + 1 as hb from fx_boxes) group by result_id""")
def _(t):
    pairs = t.fx_boxes.withColumns({"x_b": F.col("x") + F.col("partkey") % 7, "y_b": F.col("y") - F.col("partkey") % 13, "w_b": F.col("w") - 20, "h_b": F.col("h") + 1})
    return c.calibration(pairs, ["result_id"])


FLAGS = "true as has_coordinates, x2 - x1 > 30 as has_length, dimension_text <> '' as has_text, object_id % 2 = 0 as has_thickness, sub_type is not null as has_height, label <> '' as has_level"


def flags(t):
    return t.fx_objects.selectExpr("result_id", "object_id", "object_type", *FLAGS.split(", "))


@query("v2_completeness", f"select object_type, count(*) as n, floor(avg((3.0 + case when has_length then 2 else 0 end + case when has_text then 2 else 0 end + case when has_thickness then 1.5 else 0 end + case when has_height then 1.5 else 0 end + case when has_level then 1 else 0 end) / 11.0 * 100) * 10000 + 0.5) / 10000 as completeness from (select object_type, {FLAGS} from fx_objects) group by object_type")
def _(t):
    return flags(t).groupBy("object_type").agg(F.count("*").alias("n"), d.js_round(F.avg(c.completeness()), 4).alias("completeness"))


@query("v3_issues", f"""with f as (select object_type, {FLAGS} from fx_objects) select 'warning' as severity, 'wall without length or text' as message, count(*) as n from f where object_type = 'wall' and not has_length and not has_text having count(*) > 0
  union all select 'info', 'wall without thickness', count(*) from f where object_type = 'wall' and not has_thickness having count(*) > 0""")
def _(t):
    return flags(t).select(F.explode(c.issues()).alias("i")).groupBy("i.severity", "i.message").agg(F.count("*").alias("n"))


@query("v4_defaults", "select result_id, object_id, case when object_type = 'wall' then 150 else 0 end as thickness, case when h = 0 then case object_type when 'wall' then 3000 when 'door' then 2100 when 'window' then 1200 else 0 end else h end as height from (select *, (y2 - y1) % 2 as h from fx_objects)")
def _(t):
    kind = F.col("object_type")
    usual = F.when(kind == "wall", 3000).when(kind == "door", 2100).when(kind == "window", 1200).otherwise(0)
    h = (F.col("y2") - F.col("y1")) % 2
    return t.fx_objects.select("result_id", "object_id", F.when(kind == "wall", 150).otherwise(0).alias("thickness"), F.when(h == 0, usual).otherwise(h).alias("height"))


@query("o4_reading_order", """with recursive s as (select result_id, bbox_index, x, y, row_number() over (partition by result_id order by y, x, bbox_index) as rn from fx_boxes),
  r as (select result_id, bbox_index, x, rn, y as top, 0 as line from s where rn = 1 union all
    select s.result_id, s.bbox_index, s.x, s.rn, case when s.y - r.top >= 20 then s.y else r.top end, r.line + case when s.y - r.top >= 20 then 1 else 0 end from r join s on s.result_id = r.result_id and s.rn = r.rn + 1)
  select result_id, bbox_index, line, row_number() over (partition by result_id order by line, x, bbox_index) - 1 as place from r""")
def _(t):
    return s.line_order(t.fx_boxes.select("result_id", "bbox_index", "x", "y"), "result_id", "bbox_index")


def _prefixes(t):
    """What the SQL compares: prefixes, among ids that are equal modulo 40."""
    rows = t.fx_text.where((F.octet_length("raw_text") == F.length("raw_text")) & (F.octet_length("truth") == F.length("truth")))
    return rows.select("doc_id", (F.col("doc_id") % 40).alias("k"), F.substring("raw_text", 1, 60).alias("raw_text"), F.substring("truth", 1, 60).alias("truth"))


@query("j14_fuzzy_match", """select doc_id, other_id, floor(s * 10000 + 0.5) / 10000 as similarity from (select a.doc_id, b.doc_id as other_id, 1 - levenshtein(a.t, b.t) * 1.0 / greatest(length(a.t), length(b.t)) as s,
  row_number() over (partition by a.doc_id order by 1 - levenshtein(a.t, b.t) * 1.0 / greatest(length(a.t), length(b.t)) desc, b.doc_id) rn from
  (select doc_id, doc_id % 40 as k, substr(raw_text, 1, 60) as t from fx_text where strlen(raw_text) = length(raw_text)) a join (select doc_id, doc_id % 40 as k, substr(truth, 1, 60) as t from fx_text where strlen(truth) = length(truth)) b using (k)
  where 1 - levenshtein(a.t, b.t) * 1.0 / greatest(length(a.t), length(b.t)) >= 0.65) where rn = 1""", {"texts": _prefixes})
def _(t):
    key = [c for c in t.texts.columns if c == "k"]
    left = t.texts.select("doc_id", *key, F.col("raw_text").alias("text"))
    right = t.texts.select(F.col("doc_id").alias("other_id"), *key, F.col("truth").alias("other"))
    return s.fuzzy_nearest(left, right, "doc_id", "other_id", 0.65, key).select("doc_id", "other_id", d.js_round("similarity", 4).alias("similarity"))
