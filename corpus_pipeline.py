"""The corpus pipeline: quality classifier, quality rules, n-gram Jaccard join, suffix-array dedup and
best-fit packing.

Each stage is a function of (spark, docs, sf_dir) over all rows that the stage before it kept, and all but
the last return the columns of ``documents``. Rows are told apart by id and text (``row_key``), so a row
that repeats an id with another text has its own decision.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.llm.classifier import score
from quoin.llm.common import materialize, row_key, table
from quoin.llm.ngram_join import jaccard_components
from quoin.llm.packing import pack
from quoin.llm.rules import judge
from quoin.llm.suffixes import remove_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _keep(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` with a key in ``keys``."""
    keyed = docs.select(*COLUMNS).withColumn("row_key", row_key())
    return keyed.join(keys.select("row_key"), "row_key", "left_semi").select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier scores below its cutoff. It learns from the labelled among
    ``docs``; null and empty texts are scored by the bias. Without any label there is nothing to reject
    by, and all documents stay."""
    return score(docs, table(spark, sf_dir, "labels"), keep=COLUMNS).where("predicted = 1 or not learned").select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that a base rule or a risk-controlled cutoff rejects; null texts have no words and
    go."""
    return _keep(docs, judge(docs, table(spark, sf_dir, "labels")).where("kept"))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates (five words, similarity 0.8) the document with the smallest
    id. Texts without words are in no group and stay."""
    groups = jaccard_components(docs, n=5, percent=80)
    return _keep(docs, groups.where("doc_id is null and component_id is null or doc_id = component_id"))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 bytes or more that a document with a smaller id has, and updates n_chars; a
    document of which nothing is left goes."""
    cut = remove_repeats(docs, keep=COLUMNS).where("kept_text <> ''")
    return cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all that is left into sequences of 1024 tokens: one row for each piece."""
    return pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("ngram_jaccard", ngram_jaccard),
    ("suffix_dedup", suffix_dedup),
    ("best_fit_packing", best_fit_packing),
]
#: SQL cannot train the classifier or pack by local search; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
