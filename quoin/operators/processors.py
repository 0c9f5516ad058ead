"""Readers (processors) as a table: which may run on what, which keys they miss, and what they cost.

processors: processor_id, name, category, cost, confidential_safe, supports_pdf, max_pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.defaults import js_round
from ..functions.enums import cost_range
from ..functions.labels import is_pdf


def names(condition: Column) -> Column:
    return F.array_join(F.array_sort(F.collect_list(F.when(condition, F.col("name")))), ",")


def compatible(jobs: DataFrame, processors: DataFrame) -> DataFrame:
    """For each drawing of jobs (drawing_id, path, page_count, processor_id): how many readers take it, which
    are skipped as they do not read PDF, which need it split, and the smallest page limit of these. PDFs
    that no reader takes are left out."""
    rows = jobs.select("drawing_id", is_pdf("path").alias("pdf"), "page_count", "processor_id").distinct()
    rows = rows.join(F.broadcast(processors.select("processor_id", "name", "supports_pdf", "max_pages")), "processor_id")
    takes = ~F.col("pdf") | F.col("supports_pdf")
    split = F.col("pdf") & F.col("supports_pdf") & F.coalesce(F.col("page_count") > F.col("max_pages"), F.lit(False))
    out = rows.groupBy("drawing_id").agg(
        F.count_if(takes).alias("n_compatible"), names(~takes).alias("skipped"), names(split).alias("to_split"), F.min(F.when(split, F.col("max_pages"))).alias("page_limit"),
    )
    return out.where("n_compatible > 0")


def availability(keys: DataFrame, configured: DataFrame, either: dict[str, list[list[str]]]) -> DataFrame:
    """processor_id, available, missing (its own keys without a value, if it is not available).

    keys: processor_id, key_name; configured: key_name, value. A key in ``either`` is satisfied by any of
    its sets of keys. There are a few configured keys, so they are one row."""
    have = configured.where(F.trim("value") != "").agg(F.collect_set("key_name").alias("have"))
    rows = keys.distinct().join(F.broadcast(have))
    holds = lambda some: F.forall(F.array(*map(F.lit, some)), lambda k: F.array_contains("have", k))
    own = F.array_contains("have", F.col("key_name"))
    ok = own
    for name, sets in either.items():
        any_ = holds(sets[0])
        for some in sets[1:]:
            any_ = any_ | holds(some)
        ok = F.when(F.col("key_name") == name, any_).otherwise(ok)
    rows = rows.select("processor_id", "key_name", ok.alias("ok"), own.alias("own"))
    missing = F.array_join(F.array_sort(F.collect_list(F.when(~F.col("own"), F.col("key_name")))), ",")
    out = rows.groupBy("processor_id").agg(F.bool_and("ok").alias("available"), missing.alias("missing"))
    return out.withColumn("missing", F.when(F.col("available"), "").otherwise(F.col("missing")))


def by_category(processors: DataFrame) -> DataFrame:
    safe = F.col("confidential_safe")
    return processors.groupBy("category").agg(F.count("*").alias("n"), F.count_if(safe).alias("n_safe"), names(safe).alias("safe"))


def run_costs(runs: DataFrame, images: DataFrame, processors: DataFrame, key: str) -> DataFrame:
    """Lowest and highest cost of each run: its readers (key, processor_id) on all its images (key, images)."""
    prices = processors.select("processor_id", cost_range("cost").alias("c")).where("c is not null")
    sums = runs.distinct().join(F.broadcast(prices), "processor_id").groupBy(key).agg(F.sum("c.lowest").alias("lo"), F.sum("c.highest").alias("hi"))
    rows = sums.join(images, key)
    return rows.select(key, js_round(F.col("lo") * F.col("images"), 2).alias("lowest"), js_round(F.col("hi") * F.col("images"), 2).alias("highest"))
