"""Collections: documents with a schema, and the search over them.

A collection never changes; every change gives a new one whose DataFrame is derived from the old. ``checkpoint`` cuts the
lineage after many changes, ``indexed`` reads or keeps index tables instead of deriving them for each search.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .errors import DocumentNotFoundError, DocumentValidationError, QueryError
from .functions.text import Tokenizer
from .operators.filters import WhereBuilder, distance, geo_only
from .functions import geo
from .plans import index, rank, shape
from .schema import Schema, SchemaType
from .types import Algorithm, BM25Params, FacetConfig, GroupBy, SearchResult, SortBy


@dataclass
class Tables:
    """Index tables of one collection version."""

    postings: DataFrame
    vocab: DataFrame | None
    stats: index.Stats


@dataclass(frozen=True)
class Collection:
    """``docs``: ``doc_ord, id``, the declared fields, and any other columns that came along."""

    spark: SparkSession
    schema: Schema
    docs: DataFrame
    tokenizer: Tokenizer = Tokenizer()
    algorithm: Algorithm = Algorithm.BM25
    params: BM25Params = BM25Params()
    strict_compat: bool = False
    search_arrays: bool = False
    score_digits: int | None = None
    next_ord: int = 1
    next_generated: int = 0
    tables: Tables | None = field(default=None, compare=False, repr=False)

    # -- making ---------------------------------------------------------------
    @staticmethod
    def create(spark: SparkSession, schema: Schema | Mapping, algorithm: Algorithm | str = Algorithm.BM25, tokenizer: Tokenizer | None = None, language: str | None = None, **options) -> Collection:
        """An empty collection. A tokenizer excludes ``language`` and the tokenizer's other options."""
        schema = schema if isinstance(schema, Schema) else Schema(schema)
        own = {k: options.pop(k) for k in ("stemming", "stemmer", "words", "use_default_stop_words", "allow_duplicates", "skip", "stem_skip") if k in options}
        if tokenizer is not None and (language is not None or own):
            raise ValueError("give a tokenizer or its options, not both")
        if tokenizer is None:
            tokenizer = Tokenizer(language=language or "english", **own)
        empty = spark.createDataFrame([], "doc_ord long, id string").select("doc_ord", "id")
        docs = schema.conform(empty.select("id")).withColumn("doc_ord", F.lit(None).cast("long"))
        return Collection(spark, schema, docs, tokenizer, Algorithm(algorithm), **options)

    @staticmethod
    def of(docs: DataFrame, schema: Schema | Mapping, id_col: str, order_col: str | None = None, **options) -> Collection:
        """A collection over a table as it is: ids from a unique column, order from a long column. Nothing is read or checked."""
        base = Collection.create(docs.sparkSession, schema, **options)
        rows = docs.withColumns({"doc_ord": docs[order_col or id_col].cast("long"), "id": docs[id_col].cast("string")})
        return replace(base, docs=base.schema.conform(rows))

    # -- changing -------------------------------------------------------------
    def _with(self, docs: DataFrame, **more) -> Collection:
        return replace(self, docs=docs, tables=None, **more)

    def insert(self, rows: DataFrame | Iterable[Mapping]) -> Collection:
        """All rows or none. Rows without an id get the next generated number, counted from 0; a duplicate id is an error."""
        df = self._frame(rows)
        df = self.schema.conform(df)
        if "id" not in df.columns:
            df = df.withColumn("id", F.lit(None).cast("string"))
        numbered, count = _number(df, self.next_ord)
        numbered, made = _generate(numbered, self.next_generated)
        ids = numbered.select("id").unionByName(self.docs.select("id")).groupBy("id").count().filter("count > 1").limit(1).collect()
        if ids:
            raise DocumentValidationError(f"duplicate id {ids[0]['id']!r}", "id")
        return self._with(self.docs.unionByName(numbered, allowMissingColumns=True), next_ord=self.next_ord + count, next_generated=self.next_generated + made)

    def _frame(self, rows) -> DataFrame:
        if isinstance(rows, DataFrame):
            return rows
        rows = [dict(r) for r in rows]
        for r in rows:
            if r.get("id") is not None and not isinstance(r["id"], str):
                raise DocumentValidationError("id must be a string", "id")
            self._check(self.schema.fields, r, "")
        struct = self.schema.struct()
        if any("id" in r for r in rows) and "id" not in self.schema.fields:
            struct = type(struct)([*struct.fields, *self.spark.createDataFrame([], "id string").schema.fields])
        return self.spark.createDataFrame([_shape(struct, r) for r in rows], struct)

    def _check(self, fields: dict, row: Mapping, at: str) -> None:
        from .types import GeoPoint

        one = {"string": str, "number": (int, float), "boolean": bool, "enum": (str, int, float), "geopoint": (GeoPoint, Mapping)}
        for name, kind in fields.items():
            value, path = row.get(name), f"{at}{name}"
            if value is None:
                continue
            if isinstance(kind, dict):
                if not isinstance(value, Mapping):
                    raise DocumentValidationError(f"{path}: nested fields expected", path)
                self._check(kind, value, f"{path}.")
                continue
            want = one[kind.value.removesuffix("[]")]
            values = value if kind.is_array else [value]
            if kind.is_array and not isinstance(value, (list, tuple)):
                raise DocumentValidationError(f"{path}: a list expected", path)
            for v in values:
                if not isinstance(v, want) or (isinstance(v, bool) and want is not bool):
                    raise DocumentValidationError(f"{path}: {kind.value} expected", path)

    def get(self, id: str) -> DataFrame:
        return self.docs.filter(F.col("id") == id).limit(1)

    def remove(self, *ids: str) -> Collection:
        """Without these documents; unknown ids are passed over."""
        return self._with(self.docs.filter(~F.col("id").isin(list(ids)))) if ids else self

    def remove_all(self, ids: DataFrame) -> Collection:
        """Without the documents whose ids are in a frame with a column ``id``."""
        return self._with(self.docs.join(ids.select("id").distinct(), "id", "left_anti"))

    def removed_count(self, ids: DataFrame) -> int:
        return self.docs.join(ids.select("id").distinct(), "id", "left_semi").count()

    def update(self, ids: DataFrame | Iterable[str], rows: DataFrame | Iterable[Mapping]) -> Collection:
        """Remove, then insert; nothing changes if the new rows are invalid. Many ids come as a frame with a column ``id``."""
        rest = self.remove_all(ids) if isinstance(ids, DataFrame) else self.remove(*ids)
        return rest.insert(rows)

    def patch(self, id: str, changes: Mapping) -> Collection:
        """Set fields of one document; a field given as None becomes null. The document keeps its id and gets a new place."""
        unknown = [k for k in changes if k not in self.schema.fields]
        self._check(self.schema.fields, changes, "")
        old = self.get(id)
        if old.isEmpty():
            raise DocumentNotFoundError(id)
        new = old
        for k, v in changes.items():
            if k in unknown:
                continue
            struct = self.schema.struct()[k].dataType
            frame = self.spark.createDataFrame([_shape(self.schema.struct({k: self.schema.fields[k]}), {k: v})], self.schema.struct({k: self.schema.fields[k]})).select(F.col(k).cast(struct).alias("__v"))
            new = new.drop(k).crossJoin(F.broadcast(frame)).withColumnRenamed("__v", k)
        new = new.withColumn("doc_ord", F.lit(self.next_ord).cast("long")).select(*self.docs.columns)
        rest = self.docs.filter(F.col("id") != id)
        return self._with(rest.unionByName(new), next_ord=self.next_ord + 1)

    def clear(self) -> Collection:
        """No documents; numbering goes on."""
        return self._with(self.docs.limit(0))

    def count(self) -> int:
        return self.docs.count()

    def is_empty(self) -> bool:
        return self.docs.isEmpty()

    def checkpoint(self) -> Collection:
        """Write the documents to the session's checkpoint folder and go on from there."""
        return replace(self, docs=self.docs.checkpoint())

    def reindex(self, algorithm: Algorithm | str) -> Collection:
        if not self.tokenizer.portable:
            raise ValueError("a custom tokenizer or stemmer can't be carried over")
        return replace(self, algorithm=Algorithm(algorithm), tables=None)

    # -- index ----------------------------------------------------------------
    @property
    def text_paths(self) -> list[str]:
        kinds = [SchemaType.STRING, SchemaType.STRING_ARRAY] if self.search_arrays else [SchemaType.STRING]
        return self.schema.paths_of(*kinds)

    @property
    def array_paths(self) -> frozenset[str]:
        return frozenset(self.schema.paths_of(SchemaType.STRING_ARRAY))

    def postings(self, props: list[str]) -> DataFrame:
        return index.BUILDERS[self.algorithm](self.docs, props, self.tokenizer, self.array_paths)

    def indexed(self, persist: bool = True) -> Collection:
        """With postings, vocabulary and statistics of all text fields kept for the searches to come."""
        props = self.text_paths
        postings = self.postings(props)
        if persist:
            postings = postings.persist()
        vocab = index.vocabulary(postings)
        return replace(self, tables=Tables(postings, vocab.persist() if persist else vocab, index.length_stats(self.docs, props, self.tokenizer, self.array_paths)))

    def dispose(self) -> None:
        if self.tables is not None:
            self.tables.postings.unpersist()
            if self.tables.vocab is not None:
                self.tables.vocab.unpersist()

    # -- searching ------------------------------------------------------------
    def where(self, where: Mapping) -> Column:
        return WhereBuilder(self.schema, self.tokenizer, self.algorithm, self.spark, strict_compat=self.strict_compat).build(where)

    def _properties(self, properties: list[str] | None) -> list[str]:
        if properties is None:
            return self.text_paths
        for p in properties:
            if not self.schema.has(p) or p not in self.text_paths:
                raise QueryError(f"{p!r} can't be searched for text")
        return list(properties)

    def ranked(self, term: str = "", where: Mapping | None = None, properties: list[str] | None = None, exact: bool = False, tolerance: int = 0, boost: Mapping[str, float] | None = None, threshold: float = 1.0) -> DataFrame:
        """``doc_ord, score`` of every match, in no order."""
        if tolerance < 0 or not 0 <= threshold <= 1:
            raise QueryError("tolerance must not be negative, threshold lies between 0 and 1")
        props = self._properties(properties)
        allowed = self.docs.filter(self.where(where)) if where else None
        if term == "" and properties is None:
            if where and (g := geo_only(where, self.schema)):
                return self._geo(allowed, *g)
            return (self.docs if allowed is None else allowed).select("doc_ord", F.lit(0.0).alias("score"))
        tokens = self.tokenizer.tokenize(self.spark, term) if term else []
        if term == "" and self.algorithm is Algorithm.BM25:
            tokens = [""]
        if self.algorithm is Algorithm.PT15 and (exact or tolerance):
            raise QueryError("PT15 takes neither exact nor tolerance")
        rank.check_boost(boost or {}, props)
        if not tokens or not props:
            return self.docs.select("doc_ord", F.lit(0.0).alias("score")).limit(0)
        options = {}
        if self.tables is not None:
            postings, vocab, stats = self.tables.postings, self.tables.vocab, self.tables.stats
        else:
            # without an index the documents are read once, and only words that answer a token leave them
            vocab, test = None, rank.answers(tokens, exact, tolerance)
            if self.algorithm is Algorithm.BM25:
                # at threshold 0 a document's row tells whether it has every token; postings of others aren't needed
                options["complete"] = threshold <= 0 and len(tokens) > 1 and not self.strict_compat
                whole = rank.whole(tokens, exact, tolerance) if options["complete"] else None
                postings, vocab, stats = index.bm25_matches(self.docs, props, self.tokenizer, self.array_paths, test, whole)
            elif self.algorithm is Algorithm.QPS:
                postings, stats = index.qps_postings(self.docs, props, self.tokenizer, self.array_paths, test), index.Stats(0, {})
            else:
                postings, stats = index.pt15_postings(self.docs, props, self.tokenizer, self.array_paths, test), index.Stats(0, {})
        out = rank.rank(
            self.algorithm, postings, vocab, stats, props, tokens, exact=exact, tolerance=tolerance, boost=boost or {}, threshold=threshold,
            allowed=None if allowed is None else allowed.select("doc_ord"), params=self.params, strict=self.strict_compat, **options,
        )
        if exact and term:
            whole = [rf"\b{_quote(t)}\b" for t in term.split()]
            ok = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.col(p).rlike(w) for w in whole]) for p in props if p not in self.array_paths])
            out = out.join(self.docs.filter(ok).select("doc_ord"), "doc_ord", "left_semi")
        return out

    def _geo(self, rows: DataFrame, path: str, f) -> DataFrame:
        centre = f.value.centre if f.op == "geoRadius" else geo.centroid(f.value.points)
        c = F.col(path)
        rows = rows.select("doc_ord", distance(c["lat"], c["lon"], centre, f.value.precise).alias("d"))
        far = rows.agg(F.max("d").alias("far"))
        return rows.crossJoin(F.broadcast(far)).select("doc_ord", (F.col("far") - F.col("d") + 1).alias("score"))

    def search(
        self, term: str = "", where: Mapping | None = None, properties: list[str] | None = None, exact: bool = False, tolerance: int = 0, boost: Mapping[str, float] | None = None,
        threshold: float = 1.0, limit: int = 10, offset: int = 0, facets: Mapping[str, FacetConfig] | None = None, group_by: GroupBy | None = None, sort_by: SortBy | None = None,
    ) -> SearchResult:
        """Match, filter, rank, sort, page, count, facet and group, as lazy frames over one ranked set."""
        extra, order = shape.order_columns(self.schema, sort_by, self.tokenizer.language)
        scored = self.ranked(term, where, properties, exact, tolerance, boost, threshold)
        if self.score_digits is not None:
            scored = scored.withColumn("score", F.round("score", self.score_digits))
        if facets or group_by is not None:
            scored = index.keep(scored)
        ordered = scored if not extra else scored.join(self.docs.select("doc_ord", *extra), "doc_ord")
        hits = shape.page(ordered, self.docs, order, limit, offset)
        out = SearchResult(hits, scored.agg(F.count("*").alias("count")))
        if facets:
            for p in facets:
                if not self.schema.has(p):
                    raise QueryError(f"unknown facet {p!r}")
            roots = list(dict.fromkeys(p.split(".")[0] for p in facets))
            matched = scored.select("doc_ord").join(self.docs.select("doc_ord", *roots), "doc_ord")
            out.facets = shape.facets(matched, self.schema, dict(facets))
        if group_by is not None:
            for p in group_by.properties:
                if not self.schema.has(p):
                    raise QueryError(f"can't group by {p!r}")
            values = [F.col(p).alias(f"g{k}") for k, p in enumerate(group_by.properties)]
            matched = scored.join(self.docs.select("doc_ord", "id", *values, *extra), "doc_ord")
            out.groups = shape.groups(matched, self.schema, group_by, order)
        return out

    # -- looking in -----------------------------------------------------------
    @property
    def properties_with_types(self) -> dict[str, str]:
        return {p: self.schema.type_at(p).value for p in self.schema.paths}

    def external_ids(self) -> DataFrame:
        return self.docs.select("doc_ord", "id")


def _quote(term: str) -> str:
    return "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def _shape(struct, value):
    """A mapping as a tuple that fits ``struct``."""
    from pyspark.sql import types as T

    from .types import GeoPoint

    if value is None:
        return None
    if isinstance(struct, T.StructType):
        if isinstance(value, GeoPoint):
            value = {"lat": value.lat, "lon": value.lon}
        return tuple(_shape(f.dataType, value.get(f.name)) for f in struct.fields)
    if isinstance(struct, T.ArrayType):
        return [_shape(struct.elementType, v) for v in value]
    if isinstance(struct, T.DoubleType):
        return float(value)
    if isinstance(struct, T.StringType):
        return value if isinstance(value, str) else (f"{value:g}" if isinstance(value, float) else str(value))
    return value


def _number(df: DataFrame, first: int) -> tuple[DataFrame, int]:
    """``df`` with consecutive ``doc_ord`` from ``first``, without moving rows: counts by partition, then a running sum."""
    marked = df.withColumn("__at", F.monotonically_increasing_id())
    part = F.shiftright("__at", 33)
    counts = sorted(marked.groupBy(part.alias("p")).count().collect())
    base, table = first, []
    for r in counts:
        table.append((r["p"], base))
        base += r["count"]
    if not table:
        return df.withColumn("doc_ord", F.lit(None).cast("long")), 0
    starts = df.sparkSession.createDataFrame(table, "p long, base long")
    out = marked.withColumn("p", part).join(F.broadcast(starts), "p").withColumn("doc_ord", F.col("base") + F.col("__at").bitwiseAND((1 << 33) - 1))
    return out.drop("p", "base", "__at"), base - first


def _generate(numbered: DataFrame, first: int) -> tuple[DataFrame, int]:
    """Ids for the rows without one, in their order: counts by stretches of the order, then a number within each."""
    bare = numbered.filter("id IS NULL").withColumn("__b", F.shiftright("doc_ord", 16))
    base, table = first, []
    for r in sorted(bare.groupBy(F.col("__b").alias("b")).count().collect()):
        table.append((r["b"], base))
        base += r["count"]
    if not table:
        return numbered, 0
    starts = numbered.sparkSession.createDataFrame(table, "__b long, base long")
    place = F.row_number().over(Window.partitionBy("__b").orderBy("doc_ord"))
    named = bare.withColumn("__k", place).join(F.broadcast(starts), "__b").withColumn("id", (F.col("base") + F.col("__k") - 1).cast("string"))
    return numbered.filter("id IS NOT NULL").unionByName(named.select(*numbered.columns)), base - first
