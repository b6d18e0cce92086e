"""Files as documents: Markdown folders, JSON fixtures, and one-to-many adapters."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SerializationError
from ..types import SortBy

CONTENT_LIMIT = 3000


def adapt(df: DataFrame, to_documents: Callable[[dict], Iterable[Mapping]], schema: T.StructType | str) -> DataFrame:
    """Every source row to any number of documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([d for row in pdf.to_dict("records") for d in to_documents(row)], columns=names)

    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    names = kind.names
    return df.mapInPandas(run, kind)


def markdown_folder(spark: SparkSession, path: str) -> DataFrame:
    """``path, content`` of all ``.md`` files below a folder; ``path`` is relative to it."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(path, wholetext=True)
    full = F.col("_metadata.file_path")
    root = path.rstrip("/").removeprefix("file://")
    return rows.select(F.substring_index(full, f"{root}/", -1).alias("path"), F.col("value").alias("content"))


def markdown_records(rows: DataFrame, group_types: Mapping[str, str] | None = None) -> DataFrame:
    """``url, title, content, type, group``: the first ``# `` heading (or the file's name) is the title and leaves the content."""
    content = F.regexp_replace("content", "\r\n", "\n")
    heading = F.regexp_extract(content, r"(?m)^#[ \t]+(.+?)[ \t]*$", 1)
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.md$", "")
    title = F.when(heading != "", heading).otherwise(F.initcap(F.regexp_replace(stem, "[-_]+", " ")))
    body = F.btrim(F.regexp_replace(content, r"^\s*#[ \t]+[^\n]*\n?", ""), F.lit(" \n\t"))
    group = F.when(F.instr("path", "/") > 0, F.substring_index("path", "/", 1)).otherwise("root")
    kind: Column = group
    for prefix, name in (group_types or {}).items():
        kind = F.when(F.startswith("path", F.lit(prefix)), name).otherwise(kind)
    return rows.select(F.concat(F.lit("/"), F.regexp_replace("path", r"\.md$", "")).alias("url"), title.alias("title"), body.alias("content"), kind.alias("type"), group.alias("group"))


def duplicates(records: DataFrame, key: str = "url") -> DataFrame:
    """Keys that more than one record has, for a report beside the load."""
    return records.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def build_corpus(rows: DataFrame, path: str, group_types: Mapping[str, str] | None = None) -> DataFrame:
    """Write Markdown records as JSON, contents cut at ``CONTENT_LIMIT`` characters (a feature of this report format)."""
    records = markdown_records(rows, group_types).withColumn("content", F.substring("content", 1, CONTENT_LIMIT))
    records.write.mode("overwrite").json(path)
    return records


def fixture(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON array of records; anything malformed is an error."""
    return spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(schema).json(path)


def expectations(text: str) -> list[dict]:
    """Query expectations: ``name, term, properties`` and either ``expectedTopUrl`` or ``expectEmpty``."""
    try:
        rows = json.loads(text)
    except json.JSONDecodeError as e:
        raise SerializationError(str(e)) from e
    if not isinstance(rows, list):
        raise SerializationError("an array is expected")
    for k, r in enumerate(rows):
        if not isinstance(r, dict) or not isinstance(r.get("name"), str) or not isinstance(r.get("term"), str):
            raise SerializationError(f"record {k}: name and term are needed")
        if bool(r.get("expectEmpty")) == ("expectedTopUrl" in r and r["expectedTopUrl"] is not None):
            raise SerializationError(f"record {k}: either expectEmpty or expectedTopUrl")
        if (r.get("whereField") is None) != (r.get("whereEq") is None):
            raise SerializationError(f"record {k}: whereField and whereEq come together")
    return rows


def browse_or_search(collection, term: str, limit: int = 10, properties: tuple[str, ...] = ("title", "content")):
    """A blank query lists everything by title; any other one searches titles and contents."""
    if not term.strip():
        return collection.search(sort_by=SortBy("title"), limit=limit)
    return collection.search(term.strip(), properties=list(properties), limit=limit)
