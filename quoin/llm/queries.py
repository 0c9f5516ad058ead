"""The queries of this package, and their DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import classifier, licenses, ngram_join, packing, pieces, rules, suffixes, vectors, warc, wavelet
from .oracles import ORACLE  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op8_token_shards": wavelet.op8_token_shards,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op10_piece_encoding": pieces.op10_piece_encoding,
    "op1_quality_rules": rules.op1_quality_rules,
    "op7_quality_classifier": classifier.op7_quality_classifier,
    "op5_warc_bundles": warc.op5_warc_bundles,
    "op6_license_scan": licenses.op6_license_scan,
    "op4_embedding_near_dedup": vectors.op4_embedding_near_dedup,
    "op2_ngram_jaccard": ngram_join.op2_ngram_jaccard,
    "op9_suffix_dedup": suffixes.op9_suffix_dedup,
}
