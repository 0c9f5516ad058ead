"""Grouped statistics of results, boxes and objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.defaults import js_round, nvl_default, share


def histogram(value: Column, limits: list[int]) -> list[Column]:
    """``bin_<limit>`` for each limit, largest first, and ``below``: rows at least that large but not
    the one before."""
    out, upper = [], None
    for limit in limits:
        on = value >= limit if upper is None else (value >= limit) & (value < upper)
        out.append(F.count_if(on).alias(f"bin_{limit}"))
        upper = limit
    return [*out, F.count_if(value < limits[-1]).alias("below")]


def mean(value, digits: int = 4) -> Column:
    return js_round(F.avg(value), digits)


def by_tool(results: DataFrame, metrics: DataFrame, tools: DataFrame) -> DataFrame:
    """Per tool: metrics averaged over metric rows, times and costs over results; zeros without rows.
    Both grains are aggregated before they are joined."""
    per_result = results.groupBy("tool").agg(F.count("*").alias("n_results"), mean("time_ms").alias("avg_time"), F.sum("cost_cents").alias("total_cost"))
    own = metrics.join(results.select("result_id", "tool"), "result_id")
    per_metric = own.groupBy("tool").agg(mean(nvl_default("cer_pct", 0)).alias("avg_cer"), mean(nvl_default("accuracy", 0)).alias("avg_accuracy"), mean(nvl_default("coverage", 0)).alias("avg_coverage"))
    rows = tools.join(per_result, "tool", "left").join(per_metric, "tool", "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("avg_time", "avg_cer", "avg_accuracy", "avg_coverage")}
    return rows.withColumns(zero | {c: F.coalesce(F.col(c), F.lit(0)) for c in ("n_results", "total_cost")})


def review_progress(checks: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by status and their percentages."""
    counts = checks.groupBy(*keys).agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("correct", "incorrect", "unverified")])
    done = F.col("correct") + F.col("incorrect")
    return counts.withColumn("verified", done).withColumns({"progress": js_round(share("verified", "total"), 4), "correct_rate": js_round(share("correct", "verified"), 4), "incorrect_rate": js_round(share("incorrect", "verified"), 4)})


def champions(stats: DataFrame, measures: dict[str, tuple[str, bool]]) -> DataFrame:
    """For each measure (column, larger is better) the tool with the best value; ties by name; tools without a
    value are not considered. One row in a single aggregate."""
    cols = []
    for name, (column, larger) in measures.items():
        key = F.struct((-F.col(column) if larger else F.col(column)).alias("v"), F.col("tool").alias("t"))
        cols.append(F.min_by("tool", F.when(F.col(column).isNotNull(), key)).alias(name))
    return stats.agg(*cols)


def processor_summary(rows: DataFrame) -> DataFrame:
    """Per tool over batch rows (success, accuracy, cost_cents, time_ms, page): an accuracy is needed for
    a success, failures are those not successful, so the two need not add up."""
    good = F.col("success") & F.col("accuracy").isNotNull()
    value = F.when(good, F.col("accuracy"))
    out = rows.groupBy("tool").agg(
        F.count("*").alias("files"), F.count_if(good).alias("successes"), F.count_if(~F.col("success")).alias("failures"),
        mean(value).alias("avg_accuracy"), F.min(value).alias("min_accuracy"), F.max(value).alias("max_accuracy"),
        F.sum(F.when(good, F.col("cost_cents")).otherwise(0)).alias("total_cost"), F.sum(F.when(good, F.col("time_ms")).otherwise(0)).alias("total_time"), F.sum("page").alias("pages"),
    )
    return out.withColumn("success_rate", js_round(share("successes", "files"), 4))


def merged_chunks(parts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Parts of a file as one: texts of the successes in order, sums, whether all succeeded."""
    texts = F.array_sort(F.collect_list(F.when(F.col("success"), F.struct(F.col(order), F.col("text")))))
    return parts.groupBy(*keys).agg(
        F.bool_and("success").alias("success"), F.array_join(F.transform(texts, lambda x: x["text"]), "\n").alias("text"),
        F.sum("cost_cents").alias("cost_cents"), F.sum("time_ms").alias("time_ms"), F.count_if(~F.col("success")).alias("failed"),
    )
