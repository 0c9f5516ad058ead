"""Sources: drawing folders with side-car metadata, and readers' answers flattened to boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = "*.{png,jpg,jpeg,pdf}"
POINT = "array<struct<x:double,y:double>>"
PARAGRAPH_PAGES = f"array<struct<blocks:array<struct<confidence:double,paragraphs:array<struct<confidence:double,boundingBox:struct<vertices:{POINT}>,words:array<struct<symbols:array<struct<text:string>>>>>>>>>>"


def drawing_files(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """Paths of drawings: path, folder, name, base, extension, size, confidential. Contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", KINDS).option("recursiveFileLookup", recursive).load(folder).select("path", F.col("length").alias("size"))
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumn("name", name).select(
        "path", F.regexp_extract("path", r"([^/]*)/[^/]*$", 1).alias("folder"), "name", F.regexp_replace("name", r"\.[^.]*$", "").alias("base"),
        F.lower(F.element_at(F.split("name", r"\."), -1)).alias("extension"), "size", F.col("path").rlike(r"[/\\]confidential(-temp-excluded)?[/\\]").alias("confidential"),
    )


def with_truth(drawings: DataFrame, metadata: DataFrame, texts: DataFrame) -> DataFrame:
    """Ground truth of each drawing: stated in its metadata (base, full_text, full_text_file), else in the
    file they name, else in the text file of its own name (texts: base, text)."""
    named = texts.select(F.col("base").alias("named"), F.col("text").alias("named_text"))
    own = texts.select("base", F.col("text").alias("own_text"))
    rows = drawings.join(metadata, "base", "left").join(named, F.regexp_replace("full_text_file", r"\.txt$", "") == F.col("named"), "left").join(own, "base", "left")
    return rows.withColumn("truth", F.coalesce("full_text", "named_text", "own_text")).drop("named", "named_text", "own_text")


def paragraph_boxes(answers: DataFrame, json: str = "answer") -> DataFrame:
    """Paragraphs of answers with pages, blocks, paragraphs, words and symbols: symbols join to words,
    words with spaces to paragraphs."""
    rows = answers.withColumn("_pages", F.from_json(F.get_json_object(json, "$.pages"), PARAGRAPH_PAGES))
    rows = rows.select("*", F.posexplode("_pages").alias("page", "_page")).select("*", F.explode("_page.blocks").alias("_block"))
    rows = rows.select("*", F.explode("_block.paragraphs").alias("_p"))
    words = F.transform("_p.words", lambda w: F.array_join(F.transform(w["symbols"], lambda s: s["text"]), ""))
    return rows.withColumns({"page": F.col("page") + 1, "text": F.array_join(words, " "), "confidence": F.col("_p.confidence"), "bounds": F.col("_p.boundingBox.vertices")}).drop("_pages", "_page", "_block", "_p")


def word_boxes(answers: DataFrame, json: str = "answer") -> DataFrame:
    """Words of answers with ``pages[].words[]`` (content, confidence, polygon as flat numbers)."""
    from ..functions.geometry import flat_points

    pages = F.from_json(F.get_json_object(json, "$.pages"), "array<struct<pageNumber:int,words:array<struct<content:string,confidence:double,polygon:array<double>>>>>")
    rows = answers.withColumn("_page", F.explode(pages)).withColumn("_w", F.explode("_page.words"))
    return rows.withColumns({"page": F.coalesce("_page.pageNumber", F.lit(1)), "text": F.col("_w.content"), "confidence": F.col("_w.confidence"), "bounds": flat_points("_w.polygon")}).drop("_page", "_w")


def anchored_tokens(answers: DataFrame, json: str = "answer") -> DataFrame:
    """Tokens whose text is offsets into the full text; several segments join. Bounds come as shares of the
    page and go out in pixels."""
    layout = f"struct<confidence:double,textAnchor:struct<textSegments:array<struct<startIndex:int,endIndex:int>>>,boundingPoly:struct<normalizedVertices:{POINT}>>"
    schema = f"array<struct<dimension:struct<width:double,height:double>,tokens:array<struct<layout:{layout}>>>>"
    pages = F.from_json(F.get_json_object(json, "$.pages"), schema)
    rows = answers.withColumn("_full", F.get_json_object(json, "$.text")).select("*", F.posexplode(pages).alias("page", "_p")).withColumn("_t", F.explode("_p.tokens"))
    parts = F.transform("_t.layout.textAnchor.textSegments", lambda s: F.substr("_full", F.coalesce(s["startIndex"], F.lit(0)) + 1, s["endIndex"] - F.coalesce(s["startIndex"], F.lit(0))))
    size = lambda c: F.coalesce(F.col(f"_p.dimension.{c}"), F.lit(1.0))
    pixels = F.transform("_t.layout.boundingPoly.normalizedVertices", lambda v: F.struct((v["x"] * size("width")).alias("x"), (v["y"] * size("height")).alias("y")))
    return rows.withColumns({"page": F.col("page") + 1, "text": F.array_join(parts, ""), "confidence": F.col("_t.layout.confidence"), "bounds": pixels}).drop("_full", "_p", "_t")


def block_boxes(answers: DataFrame, json: str = "answer") -> DataFrame:
    """Blocks of answers as for paragraphs: paragraphs join with line breaks."""
    rows = answers.withColumn("_pages", F.from_json(F.get_json_object(json, "$.pages"), PARAGRAPH_PAGES))
    rows = rows.select("*", F.posexplode("_pages").alias("page", "_page")).select("*", F.posexplode("_page.blocks").alias("block", "_block"))
    words = lambda p: F.array_join(F.transform(p["words"], lambda w: F.array_join(F.transform(w["symbols"], lambda s: s["text"]), "")), " ")
    return rows.withColumns({"page": F.col("page") + 1, "text": F.array_join(F.transform("_block.paragraphs", words), "\n"), "confidence": F.col("_block.confidence")}).drop("_pages", "_page", "_block")


def line_boxes(answers: DataFrame, json: str = "answer") -> DataFrame:
    """Lines of answers with ``pages[].lines[]`` (content, polygon); they state no confidence."""
    from ..functions.geometry import flat_points

    pages = F.from_json(F.get_json_object(json, "$.pages"), "array<struct<pageNumber:int,lines:array<struct<content:string,polygon:array<double>>>>>")
    rows = answers.withColumn("_page", F.explode(pages)).withColumn("_l", F.explode("_page.lines"))
    return rows.withColumns({"page": F.coalesce("_page.pageNumber", F.lit(1)), "text": F.col("_l.content"), "confidence": F.lit(None).cast("double"), "bounds": flat_points("_l.polygon")}).drop("_page", "_l")


def table_cells(answers: DataFrame, json: str = "answer") -> DataFrame:
    """Cells of answers' tables: table, row, column, text."""
    tables = F.from_json(F.get_json_object(json, "$.tables"), "array<struct<rowCount:int,columnCount:int,cells:array<struct<rowIndex:int,columnIndex:int,content:string>>>>")
    rows = answers.select("*", F.posexplode(tables).alias("table", "_t")).withColumn("_c", F.explode("_t.cells"))
    return rows.withColumns({"row": F.col("_c.rowIndex"), "column": F.col("_c.columnIndex"), "text": F.col("_c.content")}).drop("_t", "_c")


def key_values(answers: DataFrame, json: str = "answer") -> DataFrame:
    """Pairs of answers that have both a key and a value."""
    pairs = F.from_json(F.get_json_object(json, "$.keyValuePairs"), "array<struct<key:struct<content:string>,value:struct<content:string>,confidence:double>>")
    rows = answers.withColumn("_p", F.explode(pairs))
    rows = rows.withColumns({"key": F.col("_p.key.content"), "value": F.col("_p.value.content"), "confidence": F.col("_p.confidence")}).drop("_p")
    return rows.where("key <> '' and value <> ''")


def side_cars(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """Metadata beside drawings (``<base>-metadata.json``): base, full_text, full_text_file, body."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*-metadata.json", recursiveFileLookup=recursive)
    base = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)-metadata\.json$", 1)
    get = lambda p: F.get_json_object("value", p)
    full = F.coalesce(get("$.fullText"), get("$.groundTruth.fullText"))
    named = F.coalesce(get("$.fullTextFile"), get("$.groundTruth.fullTextFile"))
    return files.select(base.alias("base"), full.alias("full_text"), named.alias("full_text_file"), F.col("value").alias("body"))
