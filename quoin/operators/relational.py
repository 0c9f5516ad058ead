"""Filters, look-ups, joins, first/last rows, ordering and sets over the evaluation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Readers that send images to a language model.
LLM_TOOLS = ("1-URGENT", "2-HIGH")


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == value).limit(1)


def ranked(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key; the rank limit is pushed below the sort's shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def last_per(df: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    return ranked(df, keys, [F.desc(at), F.desc(tie)])


def first_per(df: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    return ranked(df, keys, [F.asc(at), F.asc(tie)])


def matching(df: DataFrame, needle: str, *columns: str) -> DataFrame:
    """Rows that hold the needle in any of the columns, whatever the case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(needle.lower()))
    return df.where(hit)


def by_confidentiality(df: DataFrame, mode: str, flag: str = "is_confidential") -> DataFrame:
    """``exclude``, ``only`` or ``include``."""
    if mode == "include":
        return df
    return df.where(F.col(flag) if mode == "only" else ~F.col(flag))


def runs_breaking_policy(results: DataFrame, drawings: DataFrame) -> DataFrame:
    """Runs with a confidential drawing and a reader that sends images to a language model."""
    r = results.join(drawings.select("drawing_id", "is_confidential"), "drawing_id")
    sums = r.groupBy("run_id").agg(F.bool_or("is_confidential").alias("confidential"), F.bool_or(F.col("tool").isin(*LLM_TOOLS)).alias("llm"))
    return sums.where("confidential and llm").select("run_id")


def with_default(left: DataFrame, right: DataFrame, on: list[str], defaults: dict) -> DataFrame:
    """Left join with defaults where nothing matched."""
    j = left.join(right, on, "left")
    return j.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Old and new rows, the latest of each key."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return ranked(both, keys, [F.desc("_new"), F.desc(order)]).drop("_new")


def without(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(gone.select(*keys).distinct(), keys, "left_anti")


def cascade(root_ids: DataFrame, results: DataFrame, children: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What remains once the results of the drawings in ``root_ids`` go, children first."""
    gone = results.join(root_ids.select("drawing_id").distinct(), "drawing_id", "left_semi").select("result_id")
    left = {name: without(df, gone, ["result_id"]) for name, df in children.items()}
    return left | {"results": without(results, gone, ["result_id"])}


def chunks(pages: DataFrame, total: str, size: int) -> DataFrame:
    """Page ranges of at most ``size`` pages, from 1."""
    starts = F.sequence(F.lit(1).cast("long"), F.greatest(F.col(total), F.lit(1)).cast("long"), F.lit(size).cast("long"))
    return pages.withColumn("first_page", F.explode(starts)).withColumn("last_page", F.least(F.col("first_page") + size - 1, F.col(total).cast("long")))


def having_text(df: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` is there and not empty."""
    return df.where(F.col(column) != "")


def searched_runs(runs: DataFrame, results: DataFrame, drawings: DataFrame, needle: str, status: str = "all") -> DataFrame:
    """Runs whose name, description, tools or drawings' file names hold ``needle`` in any case, of the given
    status (all, completed, in-progress)."""
    low = needle.lower()
    holds = lambda c: F.coalesce(F.contains(F.lower(c), F.lit(low)), F.lit(False))
    hits = results.join(drawings.select("drawing_id", "file_name"), "drawing_id", "left").where(holds("file_name") | holds("tool"))
    hits = hits.select("run_id", F.lit(True).alias("_hit")).distinct()
    rows = runs.join(hits, "run_id", "left").where(F.lit(low == "") | holds("run_name") | holds("description") | F.coalesce("_hit", F.lit(False))).drop("_hit")
    return {"all": rows, "completed": rows.where("completed"), "in-progress": rows.where("not completed")}[status]
