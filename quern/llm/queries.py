"""Queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontamination, exact_dedup, html_extraction, line_dedup, ngram_jaccard, quality, sharding, suffix_dedup, token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_ngram_jaccard": ngram_jaccard.op3_ngram_jaccard,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_bpe": bpe.op6_bpe,
    "op7_quality": quality.op7_quality,
    "op8_sharding": sharding.op8_sharding,
    "op9_html_extraction": html_extraction.op9_html_extraction,
    "op10_token_counts": token_counts.op10_token_counts,
}

ORACLE_SQL: dict[str, str] = {
    "op1_suffix_dedup": suffix_dedup.SQL,
    "op3_ngram_jaccard": ngram_jaccard.SQL,
    "op4_exact_dedup": exact_dedup.SQL,
    "op5_line_dedup": line_dedup.SQL,
    "op8_sharding": sharding.SQL,
}
