"""Inserts, updates and upserts as new versions of a table, and folders of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def inserted(table: DataFrame, rows: DataFrame) -> DataFrame:
    """``table`` and the new rows; columns that these lack are null."""
    return table.unionByName(rows, allowMissingColumns=True)


def updated(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that ``changes`` (keys and some columns, one row for each key) name take its values, nulls too."""
    new = [c for c in changes.columns if c not in keys]
    named = changes.select(*keys, F.struct(*new).alias("_new"), F.lit(True).alias("_hit"))
    rows = table.join(named, keys, "left")
    return rows.select(*[F.when(F.col("_hit"), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in table.columns])


def upserted_checks(checks: DataFrame, new: DataFrame, boxes: DataFrame, result: str = "result_id", index: str = "bbox_index") -> tuple[DataFrame, DataFrame]:
    """Reviews (result, index, status) after ``new`` ones, and the refused: those whose index is no box of
    their result. There is one review for each box."""
    sizes = boxes.groupBy(result).agg(F.count("*").alias("_n"))
    rows = new.join(sizes, result, "left").withColumn("_ok", F.coalesce((F.col(index) >= 0) & (F.col(index) < F.col("_n")), F.lit(False)))
    good, bad = rows.where("_ok").drop("_n", "_ok"), rows.where("not _ok").drop("_n", "_ok")
    kept = checks.join(good.select(result, index), [result, index], "left_anti")
    return kept.unionByName(good), bad


def dimensions_written(objects: DataFrame, dimensions: DataFrame, keys: list[str]) -> DataFrame:
    """Objects (object_type, length, width, dimension_text) after their dimensions (keys, text, mm): a wall's
    is its length, a door's or window's its width, a room's only its text. Without a value nothing changes."""
    rows = objects.join(dimensions.select(*keys, F.col("text").alias("_text"), F.col("mm").alias("_mm")), keys, "left")
    there = F.coalesce((F.col("_mm") != 0) & ~F.isnan(F.col("_mm").cast("double")), F.lit(False))
    wall, opening = F.col("object_type") == "wall", F.col("object_type").isin("door", "window")
    known = there & (wall | opening | (F.col("object_type") == "room"))
    return rows.withColumns({
        "length": F.when(there & wall, F.col("_mm")).otherwise(F.col("length")), "width": F.when(there & opening, F.col("_mm")).otherwise(F.col("width")),
        "dimension_text": F.when(known, F.col("_text")).otherwise(F.col("dimension_text")),
    }).drop("_text", "_mm")


def folder_tree(files: DataFrame, path: str = "path") -> DataFrame:
    """One row for each folder and file below the root: parent, name, kind, depth, n_files (below a folder; 1
    for a file), n_pdf, place (folders first, then by name, within the parent). Folders are known by their
    files, so there are no empty ones."""
    from pyspark.sql import Window as W

    parts = files.select(F.filter(F.split(path, "/"), lambda p: p != "").alias("p"), F.lower(path).endswith(".pdf").alias("pdf"))
    levels = parts.select("p", "pdf", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("depth"))
    name = F.element_at("p", F.col("depth"))
    parent = F.concat(F.lit("/"), F.array_join(F.slice("p", F.lit(1), F.col("depth") - 1), "/"))
    kind = F.when(F.col("depth") == F.size("p"), "file").otherwise("folder")
    rows = levels.select(parent.alias("parent"), name.alias("name"), kind.alias("kind"), "depth", "pdf").groupBy("parent", "name", "kind", "depth")
    rows = rows.agg(F.count("*").alias("n_files"), F.count_if("pdf").alias("n_pdf"))
    place = F.row_number().over(W.partitionBy("parent").orderBy(F.col("kind") == "file", F.lower("name"), "name"))
    return rows.withColumn("place", place)
