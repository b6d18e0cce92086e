"""Result shaping: order, pages, facets, groups."""

from __future__ import annotations

from functools import reduce as fold

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions.text import sort_key
from ..schema import GROUPABLE, SORTABLE, Schema, SchemaType
from ..types import FacetConfig, FacetResult, FacetSorting, GroupBy, SortBy, SortOrder

#: pages up to this many rows are broadcast to fetch their documents
PAGE_ROWS = 100_000


def order_columns(schema: Schema, sort_by: SortBy | None, language: str) -> tuple[list[Column], list[Column]]:
    """Columns to add to ``ranked`` (from the documents) and the order over them."""
    if sort_by is None:
        return [], [F.desc("score"), F.asc("doc_ord")]
    if not schema.has(sort_by.field) or schema.type_at(sort_by.field) not in SORTABLE:
        raise QueryError(f"can't sort by {sort_by.field!r}")
    c = F.col(sort_by.field)
    key = sort_key(c, language) if schema.type_at(sort_by.field) is SchemaType.STRING else c
    up = SortOrder(sort_by.order) is SortOrder.ASC
    by = F.col("__key")
    return [key.alias("__key")], [by.asc_nulls_last(), F.asc("doc_ord")] if up else [by.desc_nulls_last(), F.desc("doc_ord")]


def page(ranked: DataFrame, docs: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    """``rank, id, score`` and the documents of one page; documents are fetched after the limit."""
    limit, offset = max(0, limit), max(0, offset)
    top = ranked.orderBy(*order).offset(offset).limit(limit)
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(*order)) + offset).select("rank", "doc_ord", "score")
    small = F.broadcast(top) if limit <= PAGE_ROWS else top
    return docs.join(small, "doc_ord").select("rank", "id", "score", *(docs[c] for c in docs.columns if c not in ("doc_ord", "id"))).orderBy("rank")


def facets(matched: DataFrame, schema: Schema, configs: dict[str, FacetConfig]) -> dict[str, FacetResult]:
    """Value counts over all matched documents (``matched`` has the facet columns)."""
    out = {}
    for path, config in configs.items():
        if not schema.has(path):
            raise QueryError(f"unknown facet {path!r}")
        kind, c = schema.type_at(path), F.col(path)
        if kind is SchemaType.GEOPOINT:
            raise QueryError(f"{path}: no facets of points")
        if kind in (SchemaType.NUMBER, SchemaType.NUMBER_ARRAY):
            ranges = list(dict.fromkeys(config.ranges))
            if not ranges:
                empty = matched.sparkSession.createDataFrame([], "value string, count long")
                out[path] = FacetResult(empty, empty.agg(F.count("*").alias("count")))
                continue

            def inside(r, c=c, kind=kind):
                return F.exists(c, lambda x: x.between(r.from_, r.to)) if kind.is_array else c.between(r.from_, r.to)

            sums = matched.agg(*(F.coalesce(F.sum(F.when(inside(r), 1).otherwise(0)), F.lit(0)).cast("long").alias(f"c{k}") for k, r in enumerate(ranges)))
            values = sums.select(F.explode(F.array(*(F.struct(F.lit(r.label).alias("value"), F.col(f"c{k}").alias("count")) for k, r in enumerate(ranges)))).alias("f")).select("f.*")
            out[path] = FacetResult(values, values.agg(F.count("*").alias("count")))
            continue
        value = F.explode(F.array_distinct(c)) if kind.is_array else c
        counts = matched.select(value.alias("value")).filter("value IS NOT NULL").groupBy(F.col("value").cast("string").alias("value")).agg(F.count("*").alias("count"))
        total = counts.agg(F.count("*").alias("count"))
        if kind is SchemaType.STRING:
            by = [F.desc("count") if FacetSorting(config.sort) is FacetSorting.DESC else F.asc("count"), F.asc("value")]
            counts = counts.orderBy(*by).offset(config.offset).limit(max(0, config.limit - config.offset))
        out[path] = FacetResult(counts, total)
    return out


def groups(matched: DataFrame, schema: Schema, by: GroupBy, order: list[Column]) -> DataFrame:
    """Hits by value: ``<properties>, index, id, score``. Each property keeps its first ``limit`` hits of a value, then all meet.

    ``matched`` has ``id, doc_ord, score``, the properties as ``g0, g1, ...`` and whatever the order needs.
    """
    for p in by.properties:
        if not schema.has(p) or schema.type_at(p) not in GROUPABLE:
            raise QueryError(f"can't group by {p!r}")
    names = [f"g{k}" for k in range(len(by.properties))]
    rows = matched
    if by.limit is not None:
        for n in names:
            rows = rows.withColumn(f"__{n}", F.row_number().over(Window.partitionBy(n).orderBy(*order)))
        rows = rows.filter(fold(lambda a, b: a & b, [(F.col(f"__{n}") <= by.limit) for n in names]))
    rows = rows.filter(fold(lambda a, b: a & b, [F.col(n).isNotNull() for n in names]))
    index = F.row_number().over(Window.partitionBy(*names).orderBy(*order)) - 1
    labels = [p.replace(".", "_") for p in by.properties]
    out = rows.select(*(F.col(n).alias(x) for n, x in zip(names, labels)), index.alias("index"), "id", "score")
    if by.reduce is None:
        return out
    reduce = by.reduce

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        hits = pdf.sort_values("index").to_dict("records")
        value = reduce.initial(len(hits))
        for k, hit in enumerate(hits):
            value = reduce.reducer(key, value, hit, k)
        return pd.DataFrame([[*key, value]], columns=[*labels, "value"])

    kinds = dict(out.dtypes)
    return out.groupBy(*labels).applyInPandas(run, ", ".join(f"`{x}` {kinds[x]}" for x in labels) + f", value {reduce.schema}")
