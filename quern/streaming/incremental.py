"""Indexing a stream of changes: every micro-batch adds postings and tombstones; reading takes the newest version of each id.

An extension for Structured Streaming: the batch form is ``insert``/``remove`` of a collection. Tables are append-only
Parquet folders, so a batch that is written again after a failure (same ``batch`` number) replaces its own files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans import index
from ..collection import Collection


def write_batch(template: Collection, changes: DataFrame, batch: int, path: str) -> None:
    """``changes``: ``id``, the declared fields, and ``deleted``. The last row of an id within a batch isn't defined: send one."""
    rows = changes.withColumn("doc_ord", F.xxhash64("id", F.lit(batch))).persist()
    try:
        docs = template.schema.conform(rows.filter("NOT deleted").drop("deleted"))
        docs.write.mode("overwrite").parquet(f"{path}/docs/batch={batch}")
        rows.select("id", "doc_ord", "deleted").write.mode("overwrite").parquet(f"{path}/versions/batch={batch}")
        postings = index.BUILDERS[template.algorithm](docs, template.text_paths, template.tokenizer, template.array_paths)
        postings.write.mode("overwrite").parquet(f"{path}/postings/batch={batch}")
    finally:
        rows.unpersist()


def start(template: Collection, changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Index a stream until it is stopped; ``processAllAvailable`` drains what there is."""
    return changes.writeStream.foreachBatch(lambda df, n: write_batch(template, df, n, path)).option("checkpointLocation", checkpoint).start()


def read(spark: SparkSession, template: Collection, path: str) -> Collection:
    """The collection as of the last batch."""
    from dataclasses import replace

    from ..collection import Tables

    versions = spark.read.parquet(f"{path}/versions")
    newest = versions.groupBy("id").agg(F.max_by(F.struct("doc_ord", "deleted"), "batch").alias("v")).select("v.*")
    live = newest.filter("NOT deleted").select("doc_ord")
    docs = spark.read.parquet(f"{path}/docs").drop("batch").join(live, "doc_ord", "left_semi")
    postings = spark.read.parquet(f"{path}/postings").drop("batch").join(live, "doc_ord", "left_semi")
    c = replace(template, docs=docs, tables=None)
    stats = index.length_stats(docs, c.text_paths, c.tokenizer, c.array_paths)
    return replace(c, tables=Tables(postings, None, stats))
