"""Snapshots of collections: a manifest beside Parquet or JSON tables.

``save`` writes documents and, if wanted, the index tables (partitioned by property and sorted by word, so that literal
prefixes prune row groups). Postings are written first, in parts of bounded size however frequent their words; vocabulary and
lengths come from what was written, so that texts are split once. ``load`` reads the manifest, checks its version and attaches the tables; without index tables
they are derived again from the documents.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from dataclasses import replace
from enum import Enum

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..collection import Collection, Tables
from ..errors import SerializationError, StorageError
from ..functions.text import Tokenizer
from ..plans import index
from ..schema import Schema
from ..types import Algorithm, BM25Params

FORMAT_VERSION = 1


class Format(str, Enum):
    PARQUET = "parquet"
    JSON = "json"


def manifest(c: Collection, format: Format, tables: bool, stats: index.Stats | None) -> dict:
    if not c.tokenizer.portable:
        raise SerializationError("a custom tokenizer or stemmer can't be written down")
    t = c.tokenizer
    return {
        "formatVersion": FORMAT_VERSION, "format": format.value, "algorithm": c.algorithm.value, "schema": json.loads(c.schema.to_json()), "nextOrd": c.next_ord, "nextGenerated": c.next_generated,
        "tokenizer": {
            "language": t.language, "stemming": t.stemming, "words": None if t.words is None else list(t.words), "useDefaultStopWords": t.use_default_stop_words,
            "allowDuplicates": t.allow_duplicates, "skip": sorted(t.skip), "stemSkip": sorted(t.stem_skip),
        },
        "params": {"k": c.params.k, "b": c.params.b, "d": c.params.d}, "strictCompat": c.strict_compat, "searchArrays": c.search_arrays, "scoreDigits": c.score_digits,
        "index": tables, "stats": None if stats is None else {"documents": stats.documents, "average": stats.average}, "docsSchema": c.docs.schema.json(),
    }


def shared_folder(spark: SparkSession) -> str:
    """A new folder beneath the session's checkpoint folder, which all executors share. Only a ``local`` master may do without one."""
    if spark.sparkContext.getCheckpointDir() is None:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if at is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise StorageError("set spark.checkpoint.dir to a folder that all executors share")
            at = f"{tempfile.gettempdir()}/quern-checkpoints"
        spark.sparkContext.setCheckpointDir(at)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def save(c: Collection, path: str, format: Format | str = Format.PARQUET, tables: bool = True, mode: str = "error") -> None:
    format = Format(format)
    manifest(c, format, False, None)  # what can't be described fails before anything is written
    own = c.tables if tables else None
    try:
        c.docs.write.format(format.value).mode(mode).save(f"{path}/docs")
        if tables and c.text_paths:
            own = _save_tables(c, own, path, format, mode)
        text = json.dumps(manifest(c, format, own is not None, own.stats if own else None))
        c.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode(mode).text(f"{path}/manifest")
    except AnalysisException as e:
        raise StorageError(f"can't write {path}: {e}", e) from e


def _save_tables(c: Collection, own: Tables | None, path: str, format: Format, mode: str) -> Tables:
    def write(rows: DataFrame, name: str) -> None:
        # by property first: it is what the writer wants, which would else sort once more by the property alone
        rows.sortWithinPartitions("prop", "word").write.format(format.value).partitionBy("prop").mode(mode).save(f"{path}/{name}")

    props = c.text_paths
    postings = own.postings if own else c.postings(props)
    # Spark cuts and joins the parts of a rebalance to one size, so a frequent beginning of words makes more parts, not a larger one
    write(postings.withColumn("begin", F.substring("word", 1, 2)).hint("rebalance", "prop", "begin").drop("begin"), "postings")
    written = c.spark.read.format(format.value).schema(postings.schema).load(f"{path}/postings")
    vocab = own.vocab if own and own.vocab is not None else index.vocabulary(written)
    write(vocab, "vocab")
    if own:
        stats = own.stats
    elif c.algorithm is Algorithm.BM25:
        stats = index.saved_stats(c.docs, props, written, c.tokenizer, c.array_paths)
    else:
        stats = index.length_stats(c.docs, props, c.tokenizer, c.array_paths)
    return Tables(written, vocab, stats)


def read_manifest(spark: SparkSession, path: str) -> dict:
    try:
        rows = spark.read.text(f"{path}/manifest", wholetext=True).collect()
    except AnalysisException as e:
        raise StorageError(f"no snapshot at {path}", e) from e
    try:
        out = json.loads("".join(r["value"] for r in rows))
    except json.JSONDecodeError as e:
        raise SerializationError(f"the manifest isn't JSON: {e}") from e
    return check_manifest(out)


def check_manifest(out) -> dict:
    if not isinstance(out, dict):
        raise SerializationError("a manifest must be an object")
    version = out.get("formatVersion")
    if not isinstance(version, int) or isinstance(version, bool) or not 1 <= version <= FORMAT_VERSION:
        raise SerializationError(f"unknown format version {version!r}")
    for key, kind in (("algorithm", str), ("schema", dict), ("tokenizer", dict), ("format", str), ("docsSchema", str)):
        if not isinstance(out.get(key), kind):
            raise SerializationError(f"{key} is missing or malformed")
    return out


def load(spark: SparkSession, path: str) -> Collection:
    from pyspark.sql.types import StructType

    m = read_manifest(spark, path)
    t = m["tokenizer"]
    try:
        tokenizer = Tokenizer(
            language=t["language"], stemming=t["stemming"], words=None if t["words"] is None else tuple(t["words"]), use_default_stop_words=t["useDefaultStopWords"],
            allow_duplicates=t["allowDuplicates"], skip=frozenset(t["skip"]), stem_skip=frozenset(t["stemSkip"]),
        )
        algorithm, format = Algorithm(m["algorithm"]), Format(m["format"])
    except (KeyError, ValueError) as e:
        raise SerializationError(f"malformed manifest: {e}") from e
    try:
        docs = spark.read.format(format.value).schema(StructType.fromJson(json.loads(m["docsSchema"]))).load(f"{path}/docs")
        c = Collection(spark, Schema.from_json(json.dumps(m["schema"])), docs, tokenizer, algorithm, BM25Params(**m["params"]), m["strictCompat"], m["searchArrays"], m["scoreDigits"], m["nextOrd"], m["nextGenerated"])
        if not m["index"]:
            return c
        stats = index.Stats(m["stats"]["documents"], m["stats"]["average"])
        return replace(c, tables=Tables(_table(spark, format, f"{path}/postings"), _table(spark, format, f"{path}/vocab"), stats))
    except AnalysisException as e:
        raise StorageError(f"a table of {path} is missing", e) from e


def _table(spark: SparkSession, format: Format, path: str) -> DataFrame:
    return spark.read.format(format.value).load(path)
