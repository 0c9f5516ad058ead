"""Queries on scalar functions: text metrics, parsers, labels and formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import defaults as d
from ..functions import labels as l
from ..functions import parsing as p
from ..functions import text as x
from .fixtures import spread
from .registry import query

PLAIN = "strlen(truth) = length(truth) and strlen(raw_text) = length(raw_text) and doc_id % 4 = 0"


def _plain(t):
    ascii_ = lambda v: F.octet_length(v) == F.length(v)
    return t.fx_text.where(ascii_("truth") & ascii_("raw_text") & (F.col("doc_id") % 4 == 0))


@query("f1_nfkc")
def _(t):
    return spread(t.documents).select("doc_id", F.md5(x.normalized("text")).alias("digest"))


@query("f2_edit_distance", f"select doc_id, levenshtein(raw_text, truth) as distance from fx_text where {PLAIN}", {"texts": _plain})
def _(t):
    return spread(t.texts).select("doc_id", x.levenshtein("raw_text", "truth").alias("distance"))


@query("f3_error_rate", f"select doc_id, floor(case when length(truth) = 0 then case when length(raw_text) = 0 then 0 else 1 end else levenshtein(raw_text, truth) * 1.0 / length(truth) end * 10000 + 0.5) / 10000 as rate from fx_text where {PLAIN}", {"texts": _plain})
def _(t):
    return spread(t.texts).select("doc_id", d.js_round(x.error_rate("raw_text", "truth"), 4).alias("rate"))


@query("f4_position_accuracy", "select doc_id, floor(len(list_filter(list_zip(string_split(truth, ''), string_split(raw_text, '')), lambda z: z[1] = z[2])) * 100.0 / length(truth) * 10000 + 0.5) / 10000 as accuracy from fx_full where length(truth) > 0")
def _(t):
    return t.texts.where(F.length("truth") > 0).select("doc_id", d.js_round(x.position_accuracy("raw_text", "truth"), 4).alias("accuracy"))


@query("f5_coverage", "select doc_id, floor(len(list_intersect(list_distinct(string_split(truth, '')), list_distinct(string_split(raw_text, '')))) * 100.0 / len(list_distinct(string_split(truth, ''))) * 10000 + 0.5) / 10000 as coverage from fx_full where length(truth) > 0")
def _(t):
    return t.texts.where(F.length("truth") > 0).select("doc_id", d.js_round(x.charset_coverage("raw_text", "truth"), 4).alias("coverage"))


@query("f6_counts", "select doc_id, length(raw_text) = length(truth) as same, length(raw_text) - length(truth) as difference from fx_full")
def _(t):
    return t.texts.select("doc_id", (F.length("raw_text") == F.length("truth")).alias("same"), (F.length("raw_text") - F.length("truth")).cast("long").alias("difference"))


@query("f7_sorted_form", "select doc_id, array_to_string(list_sort(string_split(regexp_replace(truth, '\\s', '', 'g'), '')), '') as form from fx_full")
def _(t):
    return t.texts.select("doc_id", x.sorted_form("truth").alias("form"))


FORM = "array_to_string(list_sort(string_split(regexp_replace({}, '\\s', '', 'g'), '')), '')"


@query("f8_order_free", f"select doc_id, floor(levenshtein(a, b) * 1.0 / greatest(length(a), length(b)) * 10000 + 0.5) / 10000 as rate from (select doc_id, {FORM.format('raw_text')} a, {FORM.format('truth')} b from fx_text where {PLAIN}) where greatest(length(a), length(b)) > 0", {"texts": _plain})
def _(t):
    forms = spread(t.texts).select("doc_id", x.sorted_form("raw_text").alias("a"), x.sorted_form("truth").alias("b"))
    rows = forms.select("doc_id", x.forms_error_rate("a", "b").alias("r"), F.greatest(F.length("a"), F.length("b")).alias("n"))
    return rows.where("n > 0").select("doc_id", d.js_round("r", 4).alias("rate"))


PREAMBLES = ["", "Here is the extracted text: ", "HERE IS WHAT I EXTRACTED ", "I found the following text:", "Based on the image, ", "The extracted text is:", "extracted text ", "Text from the image:", "OCR results:"]
TRAILERS = ["", "\n\nNote: a\nb", "\nPlease note: c", "\n**NOTE: d"]


@query("f9_commentary", """select p_partkey, p_name as cleaned, p_partkey % 9 > 0 or p_partkey % 4 > 0 or p_partkey % 11 = 0 as had_commentary, concat_ws('|', case when p_partkey % 11 = 0 then 'markdown code block' end, case p_partkey % 9 when 1 then 'Here is...' when 2 then 'Here is what...' when 3 then 'I found...' when 4 then 'Based on...' when 5 then 'The extracted...' when 6 then 'Extracted text:' when 7 then 'Text from image:' when 8 then 'OCR result:' end,
  case p_partkey % 4 when 1 then 'trailing Note:' when 2 then 'trailing Please note:' when 3 then 'trailing **Note:' end) as removed from part""")
def _(t):
    at = lambda items, n: F.get(F.array(*map(F.lit, items)), (F.col("p_partkey") % n).cast("int"))
    body = F.concat(at(PREAMBLES, 9), "p_name", at(TRAILERS, 4))
    answer = F.when(F.col("p_partkey") % 11 == 0, F.concat(F.lit(" ```text\n"), body, F.lit("\n``` "))).otherwise(F.concat(F.lit("\n"), body, F.lit("  ")))
    rows = t.part.select("p_partkey", x.without_commentary(answer).alias("c"))
    return rows.select("p_partkey", "c.cleaned", "c.had_commentary", F.array_join("c.removed", "|").alias("removed"))


STARTS = ["", "Here  is the extracted text: ", "EXTRACTED TEXT ", "the text in the image is: ", "Text found:", "OCR result ", "I found the following text:", "以下のテキストを抽出しました: ", "テキスト："]
ENDS = ["", " Is this helpful?", " let me know if it is not.", " Anything else?"]


@query("f10_openers", "select p_partkey, case when p_partkey % 9 = 8 then concat('：', p_name) else p_name end as cleaned from part")
def _(t):
    at = lambda items, n: F.get(F.array(*map(F.lit, items)), (F.col("p_partkey") % n).cast("int"))
    return t.part.select("p_partkey", x.without_openers(F.concat(at(STARTS, 9), "p_name", at(ENDS, 4))).alias("cleaned"))


@query("f11_coordinates", "select result_id, bbox_index, text, x / 10.0 as xleft, y / 10.0 as ytop from fx_boxes where x <= 1000 and y <= 1000 and w / 10.0 <= 100 and w > 0 and h > 0")
def _(t):
    line = F.concat_ws("|", F.concat(F.lit("  "), "text"), (F.col("y") / 10.0).cast("string"), (F.col("x") / 10.0).cast("string"), (F.col("w") / 10.0).cast("string"), (F.col("h") / 10.0).cast("string"))
    rows = t.fx_boxes.select("result_id", "bbox_index", F.concat(F.lit("header\n\n"), line, F.lit("\nx|1|2\nbad|101|1|1|1\n")).alias("answer"))
    e = rows.select("result_id", "bbox_index", F.explode(p.coordinate_lines("answer")).alias("c"))
    return e.select("result_id", "bbox_index", "c.text", F.col("c.left").alias("xleft"), F.col("c.top").alias("ytop"))


@query("f13_has_coordinates", "select result_id, bbox_index, flag <> 'N' as has from fx_boxes")
def _(t):
    answer = F.concat_ws("|", "text", "x", F.when(F.col("flag") == "N", F.lit("n/a")).otherwise(F.col("y").cast("string")), "w", "h")
    return t.fx_boxes.select("result_id", "bbox_index", p.has_coordinates(answer).alias("has"))


@query("f14_confidence", "select result_id, bbox_index, conf_pct / 100.0 as confidence from fx_boxes")
def _(t):
    answer = F.when(F.col("flag") == "N", F.concat(F.lit("I am "), F.col("conf_pct").cast("string"), F.lit("% confident"))).otherwise(F.concat(F.lit("Confidence: "), F.col("conf_pct").cast("string"), F.lit(" %")))
    return t.fx_boxes.select("result_id", "bbox_index", p.stated_confidence(answer).alias("confidence"))


@query("f17_words", "select doc_id, len(list_filter(regexp_split_to_array(truth, '(\\s|[、。，．！？])+'), lambda w: w <> '')) as n from fx_full")
def _(t):
    return t.texts.select("doc_id", F.size(x.words("truth")).cast("long").alias("n"))


@query("f16_blocks", "select doc_id, len(regexp_extract_all(concat('x \"', replace(replace(replace(truth, chr(39), ''), '\"', ''), '「', ''), '\" y'), '\"([^\"]+)\"', 1)) as n from fx_full where truth <> ''")
def _(t):
    plain = F.replace(F.replace(F.replace("truth", F.lit("'"), F.lit("")), F.lit('"'), F.lit("")), F.lit("「"), F.lit(""))
    return t.texts.where("truth <> ''").select("doc_id", F.size(x.text_blocks(F.concat(F.lit('x "'), plain, F.lit('" y')))).cast("long").alias("n"))


@query("f21_precision_recall", f"select doc_id, floor((greatest(length(raw_text), length(truth)) - levenshtein(raw_text, truth)) * 1.0 / length(raw_text) * 10000 + 0.5) / 10000 as precision_, floor((greatest(length(raw_text), length(truth)) - levenshtein(raw_text, truth)) * 1.0 / length(truth) * 10000 + 0.5) / 10000 as recall_ from fx_text where {PLAIN} and length(truth) > 0 and length(raw_text) > 0", {"texts": _plain})
def _(t):
    s = x.precision_recall_f1("raw_text", "truth")
    rows = spread(t.texts.where((F.length("truth") > 0) & (F.length("raw_text") > 0)))
    return rows.select("doc_id", d.js_round(s["precision"], 4).alias("precision_"), d.js_round(s["recall"], 4).alias("recall_"))


@query("f22_similarity", f"select doc_id, floor((1 - levenshtein(raw_text, truth) * 1.0 / greatest(length(raw_text), length(truth))) * 10000 + 0.5) / 10000 as similarity from fx_text where {PLAIN} and length(truth) > 0 and length(raw_text) > 0", {"texts": _plain})
def _(t):
    rows = spread(t.texts.where((F.length("truth") > 0) & (F.length("raw_text") > 0)))
    return rows.select("doc_id", d.js_round(x.similarity("raw_text", "truth"), 4).alias("similarity"))


DIM = "concat(substr(text, 1, 1), ',', substr(text, 2), case flag when 'A' then 'mm' when 'R' then ' m' else '' end)"


def _dims(t):
    unit = F.when(F.col("flag") == "A", "mm").when(F.col("flag") == "R", " m").otherwise("")
    return t.fx_boxes.select("result_id", "bbox_index", F.concat(F.substring("text", 1, 1), F.lit(","), F.substr("text", F.lit(2)), unit).alias("v"))


@query("f24_is_dimension", f"select result_id, bbox_index, regexp_full_match({DIM}, '[\\d,\\.]+\\s*(mm|m|cm|km|ft|in)?') as is_dimension from fx_boxes")
def _(t):
    return _dims(t).select("result_id", "bbox_index", p.is_dimension("v").alias("is_dimension"))


@query("f25_dimension_values", "select result_id, bbox_index, cast(text as double) as a, cast(text as double) as b, cast(text as double) as c, cast(substr(text, 1, 1) as double) as d from fx_boxes where flag <> 'R' or flag = 'R'")
def _(t):
    return _dims(t).select("result_id", "bbox_index", p.dimension_value("v").alias("a"), p.dimension_in_units("v").alias("b"), p.dimension_before_mm("v").alias("c"), p.first_digits("v").alias("d"))


@query("f32_labels", "select result_id, bbox_index, case when coalesce(conf_pct, 100) >= 95 then 'Excellent' when coalesce(conf_pct, 100) >= 85 then 'Good' when coalesce(conf_pct, 100) >= 75 then 'Medium' else 'Low' end as label from fx_boxes")
def _(t):
    return t.fx_boxes.select("result_id", "bbox_index", l.confidence_label(F.col("conf_pct") / F.lit(100.0)).alias("label"))


@query("f33_heat", "select result_id, bbox_index, case when c < 0.5 then concat('rgb(255, ', cast(cast(floor(255 * (c / 0.5) + 0.5) as int) as string), ', 0)') else concat('rgb(', cast(cast(floor(255 * (1 - (c - 0.5) / 0.5) + 0.5) as int) as string), ', 255, 0)') end as colour from (select result_id, bbox_index, cast(x % 9 as double) / 8 as c from fx_boxes)")
def _(t):
    return t.fx_boxes.select("result_id", "bbox_index", l.heat_colour((F.col("x") % 9) / F.lit(8.0)).alias("colour"))


@query("f34_gradient", """select metric_id, colour, case when split_part(substr(colour, 5), ',', 1)::int * 0.299 + split_part(colour, ', ', 2)::int * 0.587 + replace(split_part(colour, ', ', 3), ')', '')::int * 0.114 > 127.5 then '#000000' else '#ffffff' end as ink from
  (select metric_id, case when b <= 50 then concat('rgb(', cast(cast(floor(76 + 179 * (b / 50) + 0.5) as int) as string), ', ', cast(cast(floor(175 - 23 * (b / 50) + 0.5) as int) as string), ', ', cast(cast(floor(80 - 80 * (b / 50) + 0.5) as int) as string), ')')
   else concat('rgb(255, ', cast(cast(floor(152 - 152 * ((b - 50) / 50) + 0.5) as int) as string), ', 0)') end as colour from (select metric_id, (100.0::double - least(greatest(accuracy, 50), 100)) / 50 * 100 as b from fx_metrics))""")
def _(t):
    rows = t.fx_metrics.select("metric_id", l.gradient_colour("accuracy", "accuracy").alias("colour"))
    return rows.withColumn("ink", l.contrast_colour("colour"))


@query("f35_accuracy_class", "select metric_id, case when accuracy >= 95 then 'excellent' when accuracy >= 85 then 'good' when accuracy >= 75 then 'medium' else 'poor' end as class from fx_metrics")
def _(t):
    return t.fx_metrics.select("metric_id", l.accuracy_class("accuracy").alias("class"))


@query("f36_html_escape", "select page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#039;')) as digest from pages")
def _(t):
    return t.pages.select("page_id", F.md5(x.html_escaped("html")).alias("digest"))


@query("f38_durations", """select result_id, case when time_ms < 1000 then concat(cast(time_ms as string), 'ms') when time_ms < 60000 then printf('%.2fs', time_ms / 1000.0 + case when time_ms % 125 = 0 and time_ms % 10 = 5 then 0.001 else 0 end)
  else concat(cast(time_ms // 60000 as string), 'm ', cast(cast(floor((time_ms % 60000) / 1000.0 + 0.5) as int) as string), 's') end as shown from fx_results""")
def _(t):
    return t.fx_results.select("result_id", l.duration("time_ms").alias("shown"))


@query("f39_yen", "select result_id, printf('¥%.2f', cost_cents / 100.0) as shown from fx_results")
def _(t):
    return t.fx_results.select("result_id", l.yen(F.col("cost_cents") / F.lit(100.0)).alias("shown"))


@query("f41_templates", "select result_id, concat(tool, ': ', cast(page as string), ' of {{total}}') as shown from fx_results")
def _(t):
    values = F.create_map(F.lit("tool"), F.col("tool"), F.lit("page"), F.col("page").cast("string"))
    return t.fx_results.select("result_id", x.interpolated(F.lit("{{tool}}: {{page}} of {{total}}"), values).alias("shown"))


@query("f42_nested_value", "select event_id, json_extract_string(props, '$.k') as k from events")
def _(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("f43_mime_types", "select drawing_id, case lower(split_part(path, '.', -1)) when 'pdf' then 'application/pdf' when 'jpeg' then 'image/jpeg' else 'image/png' end as mime, lower(path) like '%.pdf' as is_pdf from fx_drawings")
def _(t):
    return t.fx_drawings.select("drawing_id", l.mime_type("path").alias("mime"), l.is_pdf("path").alias("is_pdf"))


@query("f44_feet_factor", "select n_nationkey as k, case n_nationkey % 3 when 0 then 1 / 304.8 when 1 then 3.28084 else 1.0 end as factor from nation")
def _(t):
    unit = F.when(F.col("n_nationkey") % 3 == 0, "mm").when(F.col("n_nationkey") % 3 == 1, "meters").otherwise("feet")
    return t.nation.select(F.col("n_nationkey").alias("k"), l.feet_factor(unit).alias("factor"))


@query("f19_character_differences", """with c as (select doc_id, string_split(truth, '') as w, string_split(raw_text, '') as g, greatest(length(truth), length(raw_text)) as n from fx_full where truth is not null),
  s as (select *, case when n > 10000 then cast(ceil(n / 1000.0) as bigint) else 1 end as step, case when n > 10000 then 50 else 100 end as most from c where n > 0), i as (select *, unnest(range(0, n, step)) as position from s),
  d as (select doc_id, most, position, coalesce(nullif(w[position + 1], ''), '(end)') as want, coalesce(nullif(g[position + 1], ''), '(end)') as got from i)
  select doc_id, cast(position as bigint) as position, want, got from (select *, row_number() over (partition by doc_id order by position) as rn from d where want <> got) where rn <= most""")
def _(t):
    rows = spread(t.texts).select("doc_id", F.explode(x.character_differences("raw_text", "truth")).alias("c"))
    return rows.select("doc_id", F.col("c.position").cast("long").alias("position"), "c.want", "c.got")


@query("q3_retry_seconds", "select event_id, cast(event_id % 60 as double) as seconds from events")
def _(t):
    message = F.concat(F.lit("quota exceeded, please retry in "), (F.col("event_id") % 60).cast("string"), F.lit("s"))
    return t.events.select("event_id", p.retry_seconds(message).alias("seconds"))


@query("k7_csv_rows", """select concat('"', cast(result_id as string), '-', cast(object_id as string), '","', object_type, '","', printf('%.2f', x1 * 15.0), '","', printf('%.2f', y1 * 15.0), '","', case when conf_pct >= 85 then 'YES' else 'NO' end, '"') as line from fx_objects""")
def _(t):
    from ..sources.exports import csv_line

    yes = F.when(F.col("conf_pct") >= 85, "YES").otherwise("NO")
    name = F.concat_ws("-", F.col("result_id").cast("string"), F.col("object_id").cast("string"))
    two = lambda c: F.format_string("%.2f", F.col(c) * F.lit(15.0))
    return t.fx_objects.select(csv_line(name, F.col("object_type"), two("x1"), two("y1"), yes).alias("line"))
