"""The evaluation tables, mapped from the generated star schema; the same SQL runs in Spark and DuckDB."""

from __future__ import annotations

import re

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
VIEWS = {
    "fx_drawings": """select c_custkey as drawing_id, c_name as file_name, c_mktsegment as type, c_nationkey % 5 = 0 as is_confidential,
        concat('/data/', case when c_nationkey % 5 = 0 then 'confidential/' else 'open/' end, c_name, case when c_custkey % 3 = 0 then '.PDF' when c_custkey % 3 = 1 then '.png' else '.jpeg' end) as path
        from customer""",
    "fx_results": """select o_orderkey as result_id, o_custkey as drawing_id, o_orderpriority as tool, o_orderdate as created_at,
        cast(floor(o_totalprice) as bigint) % 70000 as time_ms, cast(floor(o_totalprice) as bigint) % 500 as cost_cents, o_orderstatus <> 'P' as success,
        o_orderkey % 90 as run_id, o_orderkey % 12 + 1 as page from orders""",
    "fx_metrics": """select o_orderkey as metric_id, o_orderkey as result_id, case when o_orderkey % 11 = 0 then null else o_orderkey % 40 end as cer_pct,
        60 + o_orderkey % 41 as accuracy, 50 + (o_orderkey * 7) % 51 as coverage from orders where o_orderkey % 6 <> 0""",
    "fx_boxes": """select l_orderkey as result_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1 as bbox_index,
        case when l_linenumber = 7 then null else 100 - cast(floor(l_discount * 400 + 0.5) as bigint) end as conf_pct, l_partkey % 1000 as x, (l_partkey * 7 + l_suppkey) % 800 as y,
        20 + cast(floor(l_quantity) as bigint) as w, 10 + l_linenumber as h, cast(cast(floor(l_quantity) as bigint) * 455 as string) as text,
        l_returnflag as flag, l_linestatus as linestatus, l_partkey as partkey, case l_linenumber % 3 when 0 then 'ocr' when 1 then 'estimated' else 'synthesized' end as source from lineitem""",
    "fx_verifications": """select result_id, bbox_index, case flag when 'A' then 'correct' when 'R' then 'incorrect' else 'unverified' end as status from fx_boxes where linestatus = 'F'""",
    "fx_objects": """select b.result_id, b.bbox_index as object_id, case p.p_size % 4 when 0 then 'wall' when 1 then 'door' when 2 then 'window' else 'room' end as object_type,
        case when p.p_size % 7 = 0 then null else p.p_brand end as sub_type, p.p_type as method, b.x as x1, b.y as y1, b.x + b.w as x2, b.y + b.h as y2, b.conf_pct, b.text as dimension_text,
        case when p.p_size % 3 = 0 then '' else p.p_name end as label from fx_boxes b join part p on b.partkey = p.p_partkey""",
    "fx_text": """select doc_id, lang, substr(text, 1, 160) as truth, replace(replace(substr(text, 1, 160), 'th', 't'), 'e ', 'c ') as raw_text,
        concat('tool', cast(doc_id % 5 as string)) as tool from documents where lang = 'en'""",
    "fx_full": """select doc_id, text as truth, replace(replace(text, 'th', 't'), 'e ', 'c ') as raw_text from documents""",
    "fx_processors": """select cast(n_nationkey as bigint) as processor_id, n_name as name, case n_nationkey % 3 when 0 then 'plain' when 1 then 'hybrid' else 'experimental' end as category,
        concat('~', cast(n_nationkey % 4 as string), '.', cast(n_nationkey % 9 + 1 as string), case when n_nationkey % 2 = 0 then concat('-', cast(n_nationkey % 4 + 2 as string), '.5') else '' end, ' yen per page') as cost,
        n_nationkey % 3 = 0 as confidential_safe, n_nationkey % 4 <> 3 as supports_pdf, case when n_nationkey % 5 = 0 then null else cast(n_nationkey % 5 * 8 as bigint) end as max_pages,
        n_nationkey % 6 = 0 as recommended, n_nationkey % 7 = 0 as experimental from nation""",
    "fx_keys": """select processor_id, case when processor_id % 8 = 0 then 'vision' else concat('key', cast(processor_id % 7 as string)) end as key_name from fx_processors
        union all select processor_id, concat('key', cast(processor_id % 5 + 3 as string)) from fx_processors""",
    "fx_configured": """select concat('key', cast(r_regionkey + 1 as string)) as key_name, case when r_regionkey = 2 then '  ' else r_name end as value from region
        union all select case when r_regionkey = 0 then 'vision_account' else 'vision_project' end, r_name from region where r_regionkey < 2""",
    "fx_jobs": """select result_id, drawing_id, result_id % 25 as processor_id, drawing_id % 40 + 1 as page_count from fx_results""",
    "fx_runs": """select run_id, concat('Run ', cast(run_id as string)) as run_name, case when run_id % 2 = 0 then concat('notes ', cast(run_id as string)) end as description, run_id % 3 <> 0 as completed
        from (select distinct run_id from fx_results) r""",
    "fx_reports": """select p_partkey as report_id, concat('Missing text:', chr(10), '- "', p_name, '" near Top-Right, x', chr(10), '* ', p_brand, chr(10), chr(10), 'Wrong ones', chr(10), 'Found "', p_brand, '" but it should be "', p_type, '" at lower left',
        chr(10), '"A', cast(p_size as string), '" -> "B', cast(p_size as string), '"', chr(10), 'see "Q" (should read "R") on the left.', chr(10), 'nothing here', chr(10), case when p_partkey % 2 = 0 then concat('not found', chr(10), '"', p_type, '" in the center') else '' end) as answer from part""",
    "fx_edits": """select event_id, user_id as result_id, ts, case event_type when 'click' then 'add' when 'purchase' then 'modify' when 'error' then 'delete' else 'noop' end as op from events""",
    "fx_llm": """select conv_id, turn, role, text, concat('Extracted text: ', text, chr(10), 'Note: x') as answer from conversations""",
}

def texts(documents: DataFrame) -> DataFrame:
    """Like fx_text, of the whole texts of all documents."""
    read = F.replace(F.replace("text", F.lit("th"), F.lit("t")), F.lit("e "), F.lit("c "))
    return documents.select("doc_id", "lang", F.col("text").alias("truth"), read.alias("raw_text"), F.concat(F.lit("tool"), (F.col("doc_id") % 5).cast("string")).alias("tool"))


def spread(rows: DataFrame) -> DataFrame:
    """Rows of documents in many partitions, however few files and row groups they come from: what is done with
    a text takes far longer than to send it on."""
    return rows.repartition(4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")


class Tables:
    """Frames by name: base tables, fixture views, ``boxes_by_page`` and ``texts``, read when asked for; those in
    ``parts`` cut to a part."""

    def __init__(self, spark: SparkSession, sf_dir: str, parts: dict[str, Callable[[Tables], DataFrame]] | None = None):
        self.spark, self.sf_dir, self.held = spark, sf_dir, {}
        if parts:
            whole = Tables(spark, sf_dir)
            self.held = {n: f(whole) for n, f in parts.items()}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self.held:
            if name in VIEWS:
                self.held[name] = self.spark.sql(_named(VIEWS[name]), **{n: getattr(self, n) for n in _names(VIEWS[name])})
            elif name == "boxes_by_page":
                # fx_boxes whose plan knows that they are spread by result_id: nothing by page sends them again
                self.held[name] = self.spark.sql(_named(VIEWS["fx_boxes"]), lineitem=self.lineitem.repartition("l_orderkey"))
            elif name == "texts":
                self.held[name] = texts(self.documents)
            elif name in BASE:
                self.held[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                raise AttributeError(name)
        return self.held[name]


def _names(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\b(?:from|join)\s+(\w+)", sql)) & {*VIEWS, *BASE})


def _named(sql: str) -> str:
    return re.sub(r"\b(from|join)\s+(\w+)", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in {*VIEWS, *BASE} else m[0], sql)


def oracle(sql: str) -> str:
    """``sql`` with the views it uses as common table expressions before it."""
    used: list[str] = []

    def add(text: str) -> None:
        for n in VIEWS:
            if re.search(rf"\b{n}\b", text) and n not in used:
                add(VIEWS[n])
                used.append(n)

    add(sql)
    views = ", ".join(f"{n} as ({VIEWS[n]})" for n in used)
    body = sql.strip()
    if not views:
        return body
    if body.lower().startswith("with recursive "):
        return f"with recursive {views}, {body[15:]}"
    return f"with {views}, {body[5:]}" if body.lower().startswith("with ") else f"with {views} {body}"
