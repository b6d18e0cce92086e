"""A training-corpus pipeline over the ``documents`` table.

Every stage takes ``(spark, docs, sf_dir)``, works on all that its predecessor kept and returns the rows that it keeps
with the columns of ``documents``; the last returns token ids. ``run`` writes each result as Parquet in the shared
folder and reads it again for the next stage. Rows with a null id or text go the way that each operator defines.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quern.llm import bpe, decontamination, exact_dedup, ngram_jaccard, quality
from quern.llm.common import ensure_checkpoint_dir, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; it is trained on labelled documents among ``docs``."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document for each text."""
    return exact_dedup.deduplicate(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document for each group of near copies."""
    return ngram_jaccard.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left."""
    return bpe.encode(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_leaks),
    ("BPE encoding and decoding", tokens),
]

#: the trained classifier and the vocabulary's merges are beyond SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    home = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = f"{home}/{k}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
