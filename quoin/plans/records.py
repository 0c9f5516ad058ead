"""Queries on accuracy records, character analyses and reading orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records as r
from ..functions import text as x
from .fixtures import spread
from .registry import query

WORDS = "list_filter(regexp_split_to_array({}, '(\\s|[、。，．！？])+'), lambda w: w <> '')"
CHARACTERS = f"""with w as (select doc_id, {WORDS.format("truth")} as tw, {WORDS.format("raw_text")} as rw from fx_full),
  a as (select doc_id, c, count(*) as n from (select doc_id, unnest(string_split(array_to_string(tw, ''), '')) as c from w) where c <> '' group by all),
  b as (select doc_id, c, count(*) as n from (select doc_id, unnest(string_split(array_to_string(rw, ''), '')) as c from w) where c <> '' group by all),
  d as (select doc_id, c, coalesce(a.n, 0) - coalesce(b.n, 0) as n from a full outer join b using (doc_id, c))"""


@query("f18_character_totals", f"""{CHARACTERS} select w.doc_id, coalesce(missing, 0) as missing_total, coalesce(extra, 0) as extra_total, coalesce(words, 0) as n_missing_words from w
  left join (select doc_id, cast(sum(n) filter (where n > 0) as bigint) as missing, cast(-sum(n) filter (where n < 0) as bigint) as extra from d group by doc_id) s using (doc_id)
  left join (select v.doc_id, count(*) as words from (select doc_id, unnest(tw) as word from w) v join (select doc_id, list(c) as short from d where n > 0 group by doc_id) m on v.doc_id = m.doc_id
    where list_has_all(short, list_distinct(string_split(word, ''))) group by v.doc_id) g using (doc_id)""")
def _(t):
    a = r.character_analysis("raw_text", "truth")
    rows = spread(t.texts).select("doc_id", a.alias("a"))
    return rows.select("doc_id", "a.missing_total", "a.extra_total", F.size("a.missing_words").cast("long").alias("n_missing_words"))


@query("o8_extra_by_count", f"""{CHARACTERS}, e as (select doc_id, -n as n, c, row_number() over (partition by doc_id order by -n desc, position(c in array_to_string(rw, ''))) as rn from d join w using (doc_id) where n < 0)
  select doc_id, string_agg(concat(c, '×', cast(n as string)), ' ' order by rn) as shown from e group by doc_id""")
def _(t):
    rows = spread(t.texts).select("doc_id", r.by_count(r.character_analysis("raw_text", "truth")["extra_characters"]).alias("e")).where("size(e) > 0")
    return rows.select("doc_id", F.array_join(F.transform("e", lambda c: F.concat(c["character"], F.lit("×"), c["count"].cast("string"))), " ").alias("shown"))


@query("o10_source_words")
def _(t):
    rows = spread(t.texts).select("doc_id", F.explode(r.character_analysis("raw_text", "truth")["missing_characters"]).alias("m"))
    return rows.select("doc_id", "m.character", "m.count", F.array_join("m.source_words", " ").alias("source_words"))


@query("f20_accuracy_record")
def _(t):
    rows = r.accuracy_records(spread(t.texts.where("truth is not null")).select("doc_id", "tool", "raw_text", "truth"), "raw_text", "truth")
    plain = [c for c in rows.schema["record"].dataType.names if c not in ("differences", "analysis")]
    return rows.select("doc_id", *[F.col(f"record.{c}").alias(c) for c in plain], F.size("record.differences").alias("n_differences"), "record.analysis.missing_total", "record.analysis.extra_total")


@query("f15_segments", "select doc_id, len(list_filter(regexp_split_to_array(truth, '\\s+'), lambda w: w <> '')) as n_segments from fx_full")
def _(t):
    return t.texts.select("doc_id", F.size(x.segments("truth")).cast("long").alias("n_segments"))


@query("x1_source_counts", "select result_id, nullif(count(*) filter (where source = 'ocr'), 0) as ocr, nullif(count(*) filter (where source = 'estimated'), 0) as estimated, nullif(count(*) filter (where source = 'synthesized'), 0) as synthesized, nullif(count(*) filter (where source = 'template'), 0) as template from fx_boxes group by result_id")
def _(t):
    return r.source_counts(t.fx_boxes, ["result_id"], ["ocr", "estimated", "synthesized", "template"])
