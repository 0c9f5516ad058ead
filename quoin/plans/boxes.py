"""Queries on edited, estimated, calibrated and associated boxes, and rules on elements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes as b
from ..functions import geometry as g
from ..functions.defaults import js_round
from ..operators import scaling as c
from ..operators import synthesis as s
from .registry import query

R4 = "floor(({}) * 10000 + 0.5) / 10000"
R6 = "floor(({}) * 1000000 + 0.5) / 1000000"
T = "((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) * 1.0 / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))"
SEGMENT = "sqrt(pow(px - (x1 + greatest(0.0, least(1.0, {t})) * (x2 - x1)), 2) + pow(py - (y1 + greatest(0.0, least(1.0, {t})) * (y2 - y1)), 2))".format(t=T)


@query("g4_object_distance", f"""select result_id, object_id, {R4.format(f"case object_type when 'door' then sqrt(30.0 * 30 + pow(py - y1, 2)) when 'wall' then {SEGMENT} when 'room' then sqrt(pow(px - (x1 + x2) / 2.0, 2) + pow(py - (y1 + y2) / 2.0, 2)) end")} as distance
  from (select *, x1 + 30 as px, y2 + 40 as py from fx_objects) where object_type <> 'window'""")
def _(t):
    p = lambda x, y: g.point(F.col(x).cast("double"), F.col(y).cast("double"))
    kind = F.col("object_type")
    points = F.when(kind == "door", F.array(p("x1", "y1"))).when(kind == "wall", F.array(p("x1", "y1"), p("x2", "y2"))).when(kind == "room", F.array(p("x1", "y1"), p("x2", "y1"), p("x2", "y2"), p("x1", "y2")))
    rows = t.fx_objects.select("result_id", "object_id", (F.col("x1") + 30).alias("px"), (F.col("y2") + 40).alias("py"), F.coalesce(points, F.array().cast("array<struct<x:double,y:double>>")).alias("points"))
    rows = rows.withColumn("far", g.object_distance("px", "py", "points")).where(F.col("far") < float("inf"))
    return rows.select("result_id", "object_id", js_round("far", 4).alias("distance"))


def _shown(points):
    return F.array_join(F.transform(points, lambda p: F.concat_ws(",", p["x"].cast("long").cast("string"), p["y"].cast("long").cast("string"))), ";")


CORNERS = "concat(cast(x1 as string), ',', cast(y1 as string), ';', cast(x2 as string), ',', cast(y1 as string), ';', cast(x2 as string), ',', cast(y2 as string), ';', cast(x1 as string), ',', cast(y2 as string))"


@query("g7_ordered_boxes", f"select result_id, object_id, {CORNERS} as corners from fx_objects")
def _(t):
    p = lambda x, y: g.point(F.col(x).cast("double"), F.col(y).cast("double"))
    mixed = F.when(F.col("object_id") % 2 == 0, F.array(p("x2", "y2"), p("x1", "y1"), p("x2", "y1"), p("x1", "y2"))).otherwise(F.array(p("x1", "y2"), p("x1", "y1"), p("x2", "y1"), p("x2", "y2")))
    return t.fx_objects.select("result_id", "object_id", _shown(g.ordered_box(mixed)).alias("corners"))


@query("g8_four_points", f"select result_id, object_id, {CORNERS} as corners, concat(cast(x1 as string), ',', cast(y1 as string), ';', cast(x2 as string), ',', cast(y2 as string)) as pairs from fx_objects")
def _(t):
    flat = F.array(*[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")])
    rows = t.fx_objects.select("result_id", "object_id", g.flat_points(flat).alias("p"))
    return rows.select("result_id", "object_id", _shown(g.four_points("p")).alias("corners"), _shown("p").alias("pairs"))


HANDLES = ["top-left", "top", "top-right", "right", "bottom-right", "bottom", "bottom-left", "left"]
HANDLE = "['top-left', 'top', 'top-right', 'right', 'bottom-right', 'bottom', 'bottom-left', 'left'][cast((result_id + object_id) % 8 as int) + 1]"


@query("g13_box_edits", f"""with r as (select *, case when h like '%left%' then nx else x1 end as a, case when h like '%right%' then nx else x2 end as c, case when h like '%top%' then ny else y1 end as b, case when h like '%bottom%' then ny else y2 end as d from (select *, {HANDLE} as h, x2 - 5 as nx, y1 + 4 as ny from fx_objects)),
  m as (select *, case when c - a < 10 and h like '%left%' then c - 10 else a end as ra, case when c - a < 10 and h not like '%left%' then a + 10 else c end as rc, case when d - b < 10 and h like '%top%' then d - 10 else b end as rb, case when d - b < 10 and h not like '%top%' then b + 10 else d end as rd from r)
  select result_id, object_id, ra as x1, rb as y1, rc as x2, rd as y2, greatest(0, least(900, ra + 7)) as mx1, greatest(0, least(700, rd - 9)) as my2, least(x2, 500) as dx1, h as hit from m""")
def _(t):
    box = F.struct("x1", "y1", "x2", "y2")
    h = F.get(F.array(*map(F.lit, HANDLES)), ((F.col("result_id") + F.col("object_id")) % 8).cast("int"))
    rows = t.fx_objects.select("result_id", "object_id", box.alias("box"), h.alias("h"))
    mid_x, mid_y = (F.col("box.x1") + F.col("box.x2")) / 2.0, (F.col("box.y1") + F.col("box.y2")) / 2.0
    at_x = F.when(F.contains("h", F.lit("left")), F.col("box.x1").cast("double")).when(F.contains("h", F.lit("right")), F.col("box.x2").cast("double")).otherwise(mid_x)
    at_y = F.when(F.contains("h", F.lit("top")), F.col("box.y1").cast("double")).when(F.contains("h", F.lit("bottom")), F.col("box.y2").cast("double")).otherwise(mid_y)
    rows = rows.select("*", b.resized("box", "h", F.col("box.x2") - 5, F.col("box.y1") + 4).alias("r"), b.hit_handle("box", at_x, at_y, size=0.5).alias("hit"), b.dragged("box.x2", "box.y2", F.lit(500), "box.y1").alias("d"))
    m = b.held_in(b.moved("r", F.lit(7), F.lit(-9)), 900, 700)
    return rows.select("result_id", "object_id", "r.x1", "r.y1", "r.x2", "r.y2", m["x1"].alias("mx1"), m["y2"].alias("my2"), F.col("d.x1").alias("dx1"), "hit")


@query("g15_phrases", """select p_partkey, case p_partkey % 6 when 0 then 0.2 when 1 then 0.8 when 2 then 0.5 when 3 then 0.5 when 4 then 0.2 end as x, case p_partkey % 6 when 0 then 0.2 when 1 then 0.8 when 2 then 0.2 when 3 then 0.5 when 4 then 0.5 end as y from part""")
def _(t):
    phrases = F.array(*map(F.lit, ("near Top-Left", "lower right", "upper edge", "in the center", "left", "somewhere")))
    rows = t.part.select("p_partkey", g.phrase_position(F.get(phrases, (F.col("p_partkey") % 6).cast("int"))).alias("p"))
    return rows.select("p_partkey", "p.x", "p.y")


@query("g20_first_scale", f"""select r.result_id, coalesce({R4.format("mm / pixels")}, 100.0) as scale from (select distinct result_id from fx_objects) r left join (select result_id, cast(dimension_text as double) as mm, x2 - x1 as pixels, row_number() over (partition by result_id order by object_id) as rn from fx_objects where label <> '') o on r.result_id = o.result_id and rn = 1""")
def _(t):
    text = F.when(F.col("label") != "", F.concat("dimension_text", F.lit("mm")))
    objects = t.fx_objects.select("result_id", "object_id", text.alias("text"), (F.col("x2") - F.col("x1")).alias("pixels"))
    return c.first_scale(objects, "result_id", "object_id").select("result_id", js_round("scale", 4).alias("scale"))


def _offset():
    return F.struct(F.lit(5.0).alias("left"), F.lit(-3.0).alias("top"), F.lit(1.1).alias("scale_x"), F.lit(0.9).alias("scale_y"), (F.lit(0.5) + (F.col("result_id") % 5) * 0.1).alias("confidence"))


CAL = "x - 5.0 as cx, y + 3.0 as cy, w * 1.1 as cw, h * 0.9 as ch, 0.5 + (result_id % 5) * 0.1 as sure"


@query("g24_calibrated", f"""with g as (select result_id, bbox_index, {CAL}, x + w / 2.0 as mx, y + h / 2.0 as my from fx_boxes), a as (select result_id, x + 3 + w / 2.0 as ax, y + h / 2.0 as ay from fx_boxes where flag = 'A'),
  n as (select g.result_id, bbox_index, min(sqrt(pow(mx - ax, 2) + pow(my - ay, 2))) as far from g join a on g.result_id = a.result_id group by all),
  p as (select g.*, far, greatest(0.0, least(cx, 1000 - cw)) as qx, greatest(0.0, least(cy, 800 - ch)) as qy from g left join n on g.result_id = n.result_id and g.bbox_index = n.bbox_index)
  select result_id, bbox_index, floor(qx + 0.5) as x, floor(qy + 0.5) as y, floor(greatest(10.0, least(cw, 1000 - qx)) + 0.5) as width, floor(greatest(10.0, least(ch, 800 - qy)) + 0.5) as height, {R4.format("case when far < 500 then least(0.95, sure + 0.1) else sure end")} as confidence, case when far < 500 then 'anchor-refined' else 'offset-only' end as method_ from p""")
def _(t):
    anchors = t.fx_boxes.where("flag = 'A'").select("result_id", (F.col("x") + 3).alias("x"), "y", "w", "h")
    rows = c.with_anchor(t.fx_boxes.select("result_id", "bbox_index", "x", "y", "w", "h"), anchors, "result_id", "bbox_index")
    rows = rows.select("result_id", "bbox_index", b.calibrated("x", "y", "w", "h", _offset(), "anchor_distance", 1000.0, 800.0).alias("c"))
    return rows.select("result_id", "bbox_index", "c.x", "c.y", "c.width", "c.height", js_round("c.confidence", 4).alias("confidence"), F.col("c.method").alias("method_"))


@query("g25_fallbacks", f"""select result_id, bbox_index, floor(greatest(0.0, least(cx, 950)) + 0.5) as x, floor(greatest(0.0, least(cy, 780)) + 0.5) as y, floor(greatest(20.0, cw) + 0.5) as width, floor(greatest(10.0, ch) + 0.5) as height, {R4.format("sure * 0.7")} as confidence, {R4.format("cx")} as plain_x, {R4.format("ch")} as plain_height, {R4.format("sure * 0.6")} as plain_confidence
  from (select result_id, bbox_index, {CAL} from fx_boxes)""")
def _(t):
    rows = t.fx_boxes.select("result_id", "bbox_index", b.fallback_calibrated("x", "y", "w", "h", _offset(), 1000.0, 800.0).alias("c"), b.offset_only("x", "y", "w", "h", _offset()).alias("p"))
    return rows.select("result_id", "bbox_index", "c.x", "c.y", "c.width", "c.height", js_round("c.confidence", 4).alias("confidence"), js_round("p.x", 4).alias("plain_x"), js_round("p.height", 4).alias("plain_height"), js_round("p.confidence", 4).alias("plain_confidence"))


HINT = "case bbox_index % 3 when 0 then 'any' when 1 then 'horizontal' else 'vertical' end"
NEAR = f"""with d as (select result_id, bbox_index, x + 11 as px, y - 6 as py, {HINT} as hint from fx_boxes), o as (select result_id, object_id, x1, y1, x2, y2 from fx_objects),
  p as (select d.result_id, bbox_index, object_id, hint, abs(y2 - y1) < abs(x2 - x1) as across, abs(x2 - x1) < abs(y2 - y1) as along, floor({SEGMENT} * 100 + 0.5) / 100 as distance from d join o on d.result_id = o.result_id)"""


@query("g27_associations", f"""{NEAR} select result_id, bbox_index, object_id, distance, floor(case when hint = 'any' then 1 - distance / 200 * (distance / 200) else least(1.0, (1 - distance / 200 * (distance / 200)) * 1.2) end * 1000 + 0.5) / 1000 as confidence from p where distance <= 200 and (hint = 'any' or hint = 'horizontal' and across or hint = 'vertical' and along)""")
def _(t):
    return s.associations(_dimensions(t), _elements(t), "result_id", "bbox_index", "object_id").select("result_id", "bbox_index", "object_id", "distance", "confidence")


@query("g27_association_counts", f"""{NEAR} select result_id, bbox_index, count(*) as total, count(*) filter (where distance > 200) as too_far, count(*) filter (where distance <= 200 and (hint = 'horizontal' and not across or hint = 'vertical' and not along)) as wrong_way from p group by all""")
def _(t):
    return s.association_counts(_dimensions(t), _elements(t), "result_id", "bbox_index")


def _dimensions(t):
    hint = F.when(F.col("bbox_index") % 3 == 0, "any").when(F.col("bbox_index") % 3 == 1, "horizontal").otherwise("vertical")
    return t.fx_boxes.select("result_id", "bbox_index", (F.col("x") + 11).alias("px"), (F.col("y") - 6).alias("py"), hint.alias("hint"))


def _elements(t):
    return t.fx_objects.select("result_id", "object_id", "x1", "y1", "x2", "y2")


@query("g30_synthesised", f"""with b as (select *, x + w / 2.0 as cx, y + h / 2.0 as cy from fx_boxes), m as (select result_id, avg(cx) as mx, avg(cy) as my, avg(w * 1.0 / length(text)) as cw, avg(h * 1.0) as ch from b group by result_id),
  t as (select result_id, bbox_index as text_id, length(text) as n, case when flag = 'A' then 500.0 else mx end as ax, case when flag = 'A' then 200.0 else my end as ay, cw, ch from fx_boxes join m using (result_id) where flag <> 'N'),
  k as (select t.*, b.x as x1, b.y as y1, b.x + b.w as x2, b.y + b.h as y2, row_number() over (partition by t.result_id, text_id order by sqrt(pow(ax - cx, 2) + pow(ay - cy, 2)), b.bbox_index) as rn from t join b on t.result_id = b.result_id),
  u as (select *, y2 - y1 > (x2 - x1) * 1.5 as upright from k where rn = 1)
  select result_id, text_id, {R6.format("least(greatest(case when upright then x1 else x2 + cw * 0.5 end, 0.0), 1000 - cw * n)")} as x, {R6.format("least(greatest(case when upright then y2 + ch * 0.5 else y1 end, 0.0), 800 - ch)")} as y, {R6.format("cw * n")} as width, {R6.format("ch")} as height, 0.6 as confidence from u""")
def _(t):
    hinted = F.col("flag") == "A"
    texts = t.fx_boxes.where("flag <> 'N'").select("result_id", F.col("bbox_index").alias("text_id"), "text", F.when(hinted, 500.0).alias("px"), F.when(hinted, 200.0).alias("py"))
    made = s.synthesised(texts, t.fx_boxes.select("result_id", F.col("bbox_index").alias("box_id"), "text", "x", "y", "w", "h"), "result_id", "text_id", 1000.0, 800.0)
    return made.select("result_id", "text_id", *[js_round(v, 6).alias(v) for v in ("x", "y", "width", "height")], "confidence")


@query("g32_room_areas", f"select result_id, object_id, {R4.format('(x2 - x1) * (y2 - y1) * 15.0 * 15.0 / 1000000')} as square_metres from fx_objects where object_type = 'room'")
def _(t):
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return t.fx_objects.where("object_type = 'room'").select("result_id", "object_id", js_round(b.square_metres(area, F.lit(15.0)), 4).alias("square_metres"))


PROPERTIES = "result_id, object_id, object_type, sub_type, case when object_id % 2 = 0 then x2 - x1 end as length, case when object_id % 3 = 0 then y2 - y1 else 0 end as width, case when object_id % 4 = 0 then 120 end as thickness, case when object_id % 5 < 2 then 2500 end as height, label"


def _properties(t):
    return t.fx_objects.selectExpr(*PROPERTIES.split(", "))


@query("v1_missing_properties", f"""select result_id, object_id, case object_type when 'wall' then (coalesce(length, 0) <= 0)::int + (coalesce(thickness, 0) <= 0)::int + (coalesce(height, 0) <= 0)::int when 'room' then (coalesce(label, '') = '')::int else (coalesce(width, 0) <= 0)::int + (coalesce(height, 0) <= 0)::int end as n_missing from (select {PROPERTIES} from fx_objects)""")
def _(t):
    return _properties(t).select("result_id", "object_id", c.missing_required().alias("n_missing"))


@query("v4_imputed", f"""select object_type, count(*) as n, cast(sum(case when object_type = 'wall' and coalesce(thickness, 0) = 0 then 1 else 0 end) as bigint) as thickness_set, cast(sum(case when object_type in ('door', 'window') and coalesce(width, 0) = 0 then 1 else 0 end) as bigint) as width_set, cast(sum(case when object_type in ('wall', 'door', 'window') and height is null then 1 else 0 end) as bigint) as height_set,
  cast(sum(case when object_type = 'wall' then coalesce(nullif(thickness, 0), case when sub_type = 'Brand#11' then 200 else 150 end) else coalesce(thickness, 0) end) as bigint) as thickness, cast(sum(case object_type when 'door' then coalesce(nullif(width, 0), 900) when 'window' then coalesce(nullif(width, 0), 1200) else width end) as bigint) as width,
  cast(sum(case object_type when 'wall' then coalesce(height, 2700) when 'door' then coalesce(height, 2000) when 'window' then coalesce(height, 1200) else coalesce(height, 0) end) as bigint) as height from (select {PROPERTIES} from fx_objects) group by object_type""")
def _(t):
    rows = c.imputed(_properties(t), exterior=F.col("sub_type") == "Brand#11")
    total = lambda name: F.sum(F.coalesce(F.col(name), F.lit(0))).cast("long").alias(name)
    marks = [F.sum(F.col(f"{n}_set").cast("long")).alias(f"{n}_set") for n in ("thickness", "width", "height")]
    return rows.groupBy("object_type").agg(F.count("*").alias("n"), *marks, *map(total, ("thickness", "width", "height")))


@query("v5_checks", """with o as (select result_id, object_id, object_type, x1, y1, x2, y2, conf_pct, (x2 - x1) * 15.0 as mm, cast(dimension_text as double) as said from fx_objects)
  select 'outside image' as check_name, count(*) filter (where x1 < 0 or y1 < 0 or x2 > 1000 or y2 > 800) as affected from o union all
  select 'implausible size', count(*) filter (where object_type = 'wall' and (mm < 500 or mm > 20000) or object_type = 'door' and (mm < 600 or mm > 1000) or object_type = 'window' and (mm < 600 or mm > 2000)) from o union all
  select 'length off by 5 %', count(*) filter (where abs(mm - said) > 0.05 * said) from o union all select 'length off by 10 %', count(*) filter (where abs(mm - said) > 0.1 * said) from o union all
  select 'low confidence', count(*) filter (where conf_pct < 85) from o union all select 'orphaned dimension', count(*) from (select b.result_id from fx_boxes b where not exists (select 1 from o where o.result_id = b.result_id and o.object_id = b.bbox_index and o.object_type = 'wall'))""")
def _(t):
    objects = t.fx_objects.select("result_id", "object_id", "object_type", "x1", "y1", "x2", "y2", (F.col("conf_pct") / 100.0).alias("confidence"), ((F.col("x2") - F.col("x1")) * 15.0).alias("mm"), F.col("dimension_text").cast("double").alias("said"))
    dims = t.fx_boxes.select("result_id", F.col("bbox_index").alias("object_id"))
    return c.checks(objects, dims, objects.where("object_type = 'wall'"), ["result_id", "object_id"], 1000, 800, 0.85)
