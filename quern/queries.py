"""One query per operator of the engine over the given tables, and the same in SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .collection import Collection
from .functions import geo, highlight
from .functions.stemming import stem_array
from .functions.text import _FROM, _TO, Tokenizer, bounded_levenshtein, replace_diacritics, sort_key, splitter, stop_words
from .operators import filters as f
from .plans import index
from .sources import snapshots
from .types import FacetConfig, FacetSorting, GeoPoint, GroupBy, GroupReduce, NumberFacetRange, SortBy, SortOrder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark, sf, **options) -> Collection:
    schema = {"text": "string", "lang": "enum", "source": "enum", "n_chars": "number"}
    return Collection.of(_t(spark, sf, "documents"), schema, "doc_id", score_digits=6, **options)


def parts(spark, sf, **options) -> Collection:
    schema = {"p_name": "string", "p_brand": "string", "p_type": "enum", "p_size": "number", "p_retailprice": "number", "words": "enum[]", "sizes": "number[]", "flags": "boolean[]", "tags": "string[]"}
    rows = _t(spark, sf, "part").withColumns({
        "words": F.split("p_name", " "), "tags": F.split("p_name", " "),
        "sizes": F.array(F.col("p_size").cast("double"), (F.col("p_size") * 2).cast("double")), "flags": F.array(F.col("p_size") > 25, F.col("p_size") % 2 == 0),
    })
    return Collection.of(rows, schema, "p_partkey", score_digits=6, **options)


def labelled(spark, sf, **options) -> Collection:
    """Documents with booleans that only some have."""
    one = _t(spark, sf, "labels").groupBy("doc_id").agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic"))
    rows = _t(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars").join(one, "doc_id", "left")
    schema = {"lang": "string", "source": "string", "n_chars": "number", "good": "boolean", "toxic": "boolean"}
    return Collection.of(rows, schema, "doc_id", **options)


def orders(spark, sf) -> Collection:
    rows = _t(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return Collection.of(rows, {"o_orderstatus": "string", "o_totalprice": "number", "o_orderpriority": "enum"}, "o_orderkey")


def customers(spark, sf) -> Collection:
    lat, lon = (F.col("c_custkey") * 37 % 18000).cast("double") / 100.0 - 90, (F.col("c_custkey") * 91 % 36000).cast("double") / 100.0 - 180
    rows = _t(spark, sf, "customer").select("c_custkey", "c_name", F.struct(lat.alias("lat"), lon.alias("lon")).alias("at"))
    return Collection.of(rows, {"c_name": "string", "at": "geopoint"}, "c_custkey", score_digits=3)


# -- text analysis -----------------------------------------------------------
def tok(c: str, language: str = "english", distinct: bool = True) -> str:
    rx = splitter(language).replace("'", "''")
    out = f"list_transform(list_filter(regexp_split_to_array(lower({c}), '{rx}'), lambda x: x <> ''), lambda x: translate(x, '{_FROM}', '{_TO}'))"
    return f"list_distinct({out})" if distinct else out


@query(f"SELECT doc_id, CAST(len({tok('text')}) AS INTEGER) AS n, array_to_string(list_sort({tok('text')}), ' ') AS tokens FROM documents")
def tokenize_docs(spark, sf):
    tokens = Tokenizer().column(F.col("text"))
    return _t(spark, sf, "documents").select("doc_id", F.size(tokens).alias("n"), F.array_join(F.array_sort(tokens), " ").alias("tokens"))


@query(f"SELECT doc_id, CAST(len({tok('text', distinct=False)}) AS INTEGER) AS n, array_to_string({tok('text', distinct=False)}, ' ') AS tokens FROM documents")
def tokenize_dups(spark, sf):
    tokens = Tokenizer(allow_duplicates=True).column(F.col("text"))
    return _t(spark, sf, "documents").select("doc_id", F.size(tokens).alias("n"), F.array_join(tokens, " ").alias("tokens"))


_EN = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(stop_words("english"))) + "]"


_BARE = f"list_filter(regexp_split_to_array(lower(text), '{splitter('english').replace(chr(39), chr(39) * 2)}'), lambda x: x <> '' AND NOT list_contains({_EN}, x))"


@query(f"SELECT doc_id, CAST(len(list_distinct(list_transform({_BARE}, lambda x: translate(x, '{_FROM}', '{_TO}')))) AS INTEGER) AS n FROM documents")
def tokenize_stopwords(spark, sf):
    tokens = Tokenizer(use_default_stop_words=True).column(F.col("text"))
    return _t(spark, sf, "documents").select("doc_id", F.size(tokens).alias("n"))


_LANGS = {"en": "english", "de": "german", "fr": "french", "es": "spanish"}


@query(" UNION ALL ".join(f"SELECT doc_id, lang, CAST(len({tok('text', n)}) AS INTEGER) AS n FROM documents WHERE lang = '{k}'" for k, n in _LANGS.items()))
def tokenize_languages(spark, sf):
    docs = _t(spark, sf, "documents")
    n = F.lit(None).cast("int")
    for k in _LANGS:
        n = F.when(docs["lang"] == k, F.size(Tokenizer(k).column(docs["text"]))).otherwise(n)
    return docs.select("doc_id", "lang", n.alias("n")).filter("n IS NOT NULL")


@query(f"SELECT doc_id, translate(text, '{_FROM}', '{_TO}') AS text FROM documents")
def diacritics(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", replace_diacritics(F.col("text")).alias("text"))


@query("""SELECT p_partkey, CAST(k AS INTEGER) AS k, CAST(CASE WHEN starts_with(w, 'smal') THEN 0 WHEN levenshtein('smal', w) <= 3 THEN levenshtein('smal', w) END AS INTEGER) AS edits,
CAST(levenshtein('gear', w) AS INTEGER) AS plain FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS k FROM part)""")
def edit_distance(spark, sf):
    words = _t(spark, sf, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("k", "w"))
    return words.select("p_partkey", "k", bounded_levenshtein(F.lit("smal"), F.col("w"), 3).cast("int").alias("edits"), F.levenshtein(F.lit("gear"), "w").alias("plain"))


@query()
def stem_en(spark, sf):
    words = _t(spark, sf, "documents").filter("lang = 'en'").select(F.explode(Tokenizer().column(F.col("text"))).alias("word")).distinct()
    return words.select("word", stem_array(F.array("word"), "english")[0].alias("stem"))


# -- index tables ------------------------------------------------------------
@query(f"SELECT word, count(*) AS df FROM (SELECT unnest({tok('text')}) AS word FROM documents) GROUP BY word")
def vocab_df(spark, sf):
    return index.vocabulary(documents(spark, sf).postings(["text"])).select("word", "df")


@query(f"SELECT doc_id, CAST(len(t) AS INTEGER) AS n, round(avg(len(t)) OVER (), 6) AS avg_len FROM (SELECT doc_id, {tok('text')} AS t FROM documents)")
def doc_len_avg(spark, sf):
    c = documents(spark, sf)
    stats = index.length_stats(c.docs, ["text"], c.tokenizer)
    return c.docs.select("doc_id", F.size(c.tokenizer.column(F.col("text"))).alias("n"), F.round(F.lit(stats.average["text"]), 6).alias("avg_len"))


@query(f"SELECT doc_id, word, round(count(*) / n, 9) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS word FROM (SELECT doc_id, {tok('text', distinct=False)} AS t FROM documents)) GROUP BY doc_id, n, word")
def tf_table(spark, sf):
    c = documents(spark, sf, allow_duplicates=True)
    rows = c.postings(["text"])
    # postings count within a document; rows that share an id, if any, are added up as the SQL does
    again = c.docs.groupBy("doc_ord").count().filter("count > 1").select(F.col("doc_ord").alias("again"))
    if n := again.count():
        same = F.col("doc_ord").eqNullSafe(F.col("again"))
        again = F.broadcast(again) if n < 1_000_000 else again
        added = rows.join(again, same, "left_semi").groupBy("doc_ord", "n_tokens", "word").agg(F.sum("tf").alias("tf"))
        rows = rows.join(again, same, "left_anti").unionByName(added, allowMissingColumns=True)
    return rows.select(F.col("doc_ord").alias("doc_id"), "word", F.round("tf", 9).alias("tf"))


# -- ranking -----------------------------------------------------------------
def starts(*tokens: str) -> list[str]:
    return [f"starts_with(word, '{t}')" for t in tokens]


def bm25_sql(table: str, key: str, props: dict[str, float], tests: list[str], where: str = "true", threshold: float = 1, exact: str = "true", tail: str | None = None, limit: int | None = 10) -> str:
    post = " UNION ALL ".join(f"SELECT id, '{p}' AS prop, {b} AS boost, len(t) AS n, unnest(t) AS word FROM (SELECT {key} AS id, {tok(p)} AS t FROM {table})" for p, b in props.items())
    stat = " UNION ALL ".join(f"SELECT '{p}' AS prop, count(*) AS docs, avg(len({tok(p)})) AS mean FROM {table}" for p in props)
    hits = " + ".join(f"CAST({t} AS INT)" for t in tests)
    full = " AND ".join(f"bool_or({t})" for t in tests)
    pick = "SELECT id, score FROM g"
    if threshold == 0:
        pick = "SELECT id, score FROM g WHERE whole"
    elif threshold < 1:
        pick = f"""SELECT id, score FROM (SELECT *, row_number() OVER (PARTITION BY whole ORDER BY score DESC, id) AS k, count(*) FILTER (WHERE NOT whole) OVER () AS rest, bool_or(whole) OVER () AS any_ FROM g)
        WHERE whole OR NOT any_ OR k <= ceil(rest * {threshold})"""
    page = f"SELECT row_number() OVER (ORDER BY score DESC, id) AS rank, CAST(id AS VARCHAR) AS id, score FROM r ORDER BY score DESC, r.id LIMIT {limit}" if tail is None else tail
    return f"""WITH post AS ({post}), stat AS ({stat}), m AS (SELECT *, {hits} AS hits FROM post WHERE {' OR '.join(tests)}),
    df AS (SELECT prop, word, count(*) AS df FROM m GROUP BY prop, word),
    s AS (SELECT m.id, m.prop, m.word, boost * hits * ln(1 + (docs - df + 0.5) / (df + 0.5)) * (0.5 + (1.0 / n) * 2.2) / ((1.0 / n) + 1.2 * (0.25 + 0.75 * n / mean)) AS s
      FROM m JOIN df USING (prop, word) JOIN stat USING (prop) WHERE m.id IN (SELECT {key} FROM {table} WHERE ({where}) AND ({exact}))),
    w AS (SELECT id, prop, sum(s) AS s, {full} AS whole FROM s GROUP BY id, prop),
    g AS (SELECT id, round(sum(s), 6) AS score, bool_or(whole) AS whole FROM w GROUP BY id),
    r AS ({pick}) {page}"""


def top(result) -> DataFrame:
    return result.hits.select(F.col("rank").cast("long").alias("rank"), "id", "score")


def every(c: Collection, ranked: DataFrame) -> DataFrame:
    return ranked.select(F.col("doc_ord").cast("string").alias("id"), F.round("score", 6).alias("score"))


ALL = "SELECT CAST(id AS VARCHAR) AS id, score FROM r"


@query(bm25_sql("documents", "doc_id", {"text": 1}, starts("erin", "anthe")))
def bm25_top10(spark, sf):
    return top(documents(spark, sf).search("erin anthe"))


@query(bm25_sql("documents", "doc_id", {"text": 1}, starts("erin", "anthe"), tail=ALL))
def bm25_all(spark, sf):
    c = documents(spark, sf)
    return every(c, c.ranked("erin anthe"))


@query(bm25_sql("part", "p_partkey", {"p_name": 2.5, "p_brand": 0.5}, starts("blue", "brand"), tail=ALL))
def bm25_multi_prop_boost(spark, sf):
    c = parts(spark, sf)
    return every(c, c.ranked("blue brand", properties=["p_name", "p_brand"], boost={"p_name": 2.5, "p_brand": 0.5}))


@query(bm25_sql("documents", "doc_id", {"text": 1}, starts("erin", "anthe"), where="n_chars BETWEEN 500 AND 3000 AND source IN ('src1', 'src2', 'src3')", tail=ALL))
def bm25_where(spark, sf):
    c = documents(spark, sf)
    return every(c, c.ranked("erin anthe", where={"n_chars": f.between(500, 3000), "source": f.in_(["src1", "src2", "src3"])}))


@query(bm25_sql("documents", "doc_id", {"text": 1}, starts("erin", "anthe"), threshold=0, tail=ALL))
def bm25_threshold0(spark, sf):
    c = documents(spark, sf)
    return every(c, c.ranked("erin anthe", threshold=0))


@query(bm25_sql("documents", "doc_id", {"text": 1}, starts("erin", "anthe"), threshold=0.5, tail=ALL))
def bm25_threshold_half(spark, sf):
    c = documents(spark, sf)
    return every(c, c.ranked("erin anthe", threshold=0.5))


@query(bm25_sql("part", "p_partkey", {"p_name": 1}, starts("g"), tail=ALL))
def prefix_search(spark, sf):
    c = parts(spark, sf)
    return every(c, c.ranked("g", properties=["p_name"]))


@query(bm25_sql("part", "p_partkey", {"p_name": 1}, ["word = 'ring'", "word = 'red'"], exact="regexp_matches(p_name, '\\bring\\b') AND regexp_matches(p_name, '\\bred\\b')", tail=ALL))
def exact_search(spark, sf):
    c = parts(spark, sf)
    return every(c, c.ranked("ring red", properties=["p_name"], exact=True))


def _near(t: str, k: int) -> str:
    return f"(starts_with(word, '{t}') OR levenshtein('{t}', word) <= {k})"


@query(bm25_sql("part", "p_partkey", {"p_name": 1}, [_near("rong", 1)], tail=ALL))
def fuzzy_search_1(spark, sf):
    c = parts(spark, sf)
    return every(c, c.ranked("rong", properties=["p_name"], tolerance=1))


@query(bm25_sql("documents", "doc_id", {"text": 1}, [_near("thesha", 2)], tail=ALL))
def fuzzy_search_2(spark, sf):
    c = documents(spark, sf)
    return every(c, c.ranked("thesha", properties=["text"], tolerance=2))


@query(bm25_sql("part", "p_partkey", {"p_name": 1}, ["true"], tail=ALL))
def empty_term_props(spark, sf):
    c = parts(spark, sf)
    return every(c, c.ranked("", properties=["p_name"]))


@query("SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE false")
def no_token_term(spark, sf):
    return documents(spark, sf).ranked("  .. ").select(F.col("doc_ord").cast("string").alias("id"))


_MANY = [f"{a}{b}" for a in "aeiou" for b in "lmnrst"] + [a + b for a in "bcdfg" for b in "aeiou"] + [a + b for a in "hjkpqvw" for b in "aeiouy"]


@query(f"""WITH w AS (SELECT doc_id, unnest({tok('text')}) AS word FROM documents), t AS (SELECT unnest([{", ".join(f"'{t}'" for t in _MANY)}]) AS t)
SELECT CAST(doc_id AS VARCHAR) AS id FROM w JOIN t ON starts_with(word, t) GROUP BY doc_id HAVING count(DISTINCT t) = {len(_MANY)}""")
def bm25_many_tokens(spark, sf):
    """Threshold 0 with more tokens than one mask takes."""
    return documents(spark, sf).ranked(" ".join(_MANY), threshold=0).select(F.col("doc_ord").cast("string").alias("id"))


@query(bm25_sql("(SELECT * FROM documents WHERE source <> 'src1')", "doc_id", {"text": 1}, starts("erin", "anthe"), tail=ALL))
def bm25_after_remove(spark, sf):
    c = documents(spark, sf).indexed()
    gone = _t(spark, sf, "documents").filter("source = 'src1'").select(F.col("doc_id").cast("string").alias("id"))
    return every(c, c.remove_all(gone).ranked("erin anthe"))


@query(SQL["bm25_all"])
def snapshot_search(spark, sf):
    """Saved with its index, loaded again and searched."""
    at = snapshots.shared_folder(spark)
    snapshots.save(documents(spark, sf), at)
    c = snapshots.load(spark, at)
    return every(c, c.ranked("erin anthe"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_name, CAST(p_size AS DOUBLE) AS p_size FROM part WHERE p_size <> 3")
def snapshot_json(spark, sf):
    """Saved as JSON without an index, loaded again and changed."""
    at = snapshots.shared_folder(spark)
    snapshots.save(_names(spark, sf), at, "json", tables=False)
    gone = _t(spark, sf, "part").filter("p_size = 3").select(F.col("p_partkey").cast("string").alias("id"))
    return snapshots.load(spark, at).remove_all(gone).docs.select("id", "p_name", "p_size")


def _nested(spark, sf) -> Collection:
    rows = _t(spark, sf, "part").select("p_partkey", F.struct("p_name", F.struct(F.col("p_brand").alias("brand"), F.col("p_size").cast("double").alias("size")).alias("of")).alias("item"))
    return Collection.of(rows, {"item": {"p_name": "string", "of": {"brand": "enum", "size": "number"}}}, "p_partkey", score_digits=6)


@query(bm25_sql("part", "p_partkey", {"p_name": 3.0}, starts("red", "b"), where="p_size > 20", tail=ALL))
def nested_search(spark, sf):
    c = _nested(spark, sf)
    return every(c, c.ranked("red b", boost={"item.p_name": 3.0}, where={"item.of.size": f.gt(20)}))


@query("SELECT p_brand AS value, count(*) AS count FROM part WHERE p_size > 20 GROUP BY p_brand")
def nested_facet(spark, sf):
    return _facet(_nested(spark, sf).search(where={"item.of.size": f.gt(20)}, facets={"item.of.brand": FacetConfig()}), "item.of.brand")


@query("SELECT row_number() OVER (ORDER BY p_size DESC, p_partkey DESC) AS rank, CAST(p_partkey AS VARCHAR) AS id FROM part ORDER BY p_size DESC, p_partkey DESC LIMIT 40")
def nested_sort(spark, sf):
    return _ranks(_nested(spark, sf).search(sort_by=SortBy("item.of.size", SortOrder.DESC), limit=40))


def qps_sql(tests: list[str], tokens: list[str]) -> str:
    words = ", ".join(f"'{t}'" for t in tokens)
    return f"""WITH s AS (SELECT doc_id, unnest(string_split_regex(text, '[.?!]')) AS s, generate_subscripts(string_split_regex(text, '[.?!]'), 1) AS k FROM documents),
    t AS (SELECT doc_id, k, {tok('s')} AS t FROM s),
    q AS (SELECT doc_id, t, least(19, coalesce(sum(CASE WHEN len(t) > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS q FROM t),
    n AS (SELECT doc_id, sum(len(t)) AS n FROM t GROUP BY doc_id),
    p AS (SELECT doc_id, word, count(*) AS occ, bit_or(CAST(1 AS INT) << CAST(q AS INT)) AS mask FROM (SELECT doc_id, q, unnest(t) AS word FROM q) GROUP BY doc_id, word)
    SELECT CAST(doc_id AS VARCHAR) AS id, round(sum(occ * occ / n + CASE WHEN word IN ({words}) THEN 1 ELSE 0 END) + 2 * (sum(bit_count(mask)) - bit_count(bit_or(mask))), 6) AS score
    FROM p JOIN n USING (doc_id) WHERE {' OR '.join(tests)} GROUP BY doc_id"""


@query(qps_sql(starts("erin", "anthe"), ["erin", "anthe"]))
def qps_search(spark, sf):
    c = documents(spark, sf, algorithm="qps")
    return every(c, c.ranked("erin anthe"))


@query(qps_sql(["word = 'the'", "word = 'and'"], ["the", "and"]))
def qps_exact(spark, sf):
    c = documents(spark, sf, algorithm="qps")
    return every(c, c.ranked("the and", exact=True).join(c.docs.select("doc_ord"), "doc_ord"))


SQL["qps_exact"] = f"SELECT q.* FROM ({SQL['qps_exact']}) q JOIN documents d ON q.id = CAST(d.doc_id AS VARCHAR) WHERE regexp_matches(d.text, '\\bthe\\b') AND regexp_matches(d.text, '\\band\\b')"


def pt15_sql(table: str, key: str, props: dict[str, float], tokens: list[str]) -> str:
    one = " UNION ALL ".join(
        f"SELECT id, {b} AS boost, word, row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS pos, count(*) OVER (PARTITION BY id) AS n FROM (SELECT id, word, min(k) AS k FROM (SELECT {key} AS id, unnest({tok(p, distinct=False)}) AS word, generate_subscripts({tok(p, distinct=False)}, 1) AS k FROM {table}) GROUP BY id, word)"
        for p, b in props.items()
    )
    hits = " + ".join(f"CAST(starts_with(word, '{t}') AS INT)" for t in tokens)
    return f"SELECT CAST(id AS VARCHAR) AS id, round(sum(boost * ({hits}) * (14 - CASE WHEN n < 15 THEN pos ELSE (pos * 15) // n END)), 6) AS score FROM ({one}) WHERE {' OR '.join(starts(*tokens))} GROUP BY id"


@query(pt15_sql("documents", "doc_id", {"text": 1.0}, ["erin", "anthe"]))
def pt15_search(spark, sf):
    c = documents(spark, sf, algorithm="pt15")
    return every(c, c.ranked("erin anthe"))


@query(pt15_sql("part", "p_partkey", {"p_name": 2.0, "p_brand": 1.0}, ["b"]))
def pt15_multi_prop(spark, sf):
    c = parts(spark, sf, algorithm="pt15")
    return every(c, c.ranked("b", properties=["p_name", "p_brand"], boost={"p_name": 2.0}))


# -- filters -----------------------------------------------------------------
def _filter(name: str, make: Callable, table: str, key: str, where: dict, sql: str) -> None:
    def run(spark, sf):
        c = make(spark, sf)
        return c.docs.filter(c.where(where)).select("id")

    QUERIES[name] = run
    SQL[name] = f"SELECT CAST({key} AS VARCHAR) AS id FROM {table} WHERE {sql}"


_P = ("part", "p_partkey")
_filter("filter_eq_number", parts, *_P, {"p_size": f.eq(7)}, "p_size = 7")
_filter("filter_gt", parts, *_P, {"p_size": f.gt(40)}, "p_size > 40")
_filter("filter_gte", parts, *_P, {"p_size": f.gte(40)}, "p_size >= 40")
_filter("filter_lt", parts, *_P, {"p_retailprice": f.lt(950)}, "p_retailprice < 950")
_filter("filter_lte", parts, *_P, {"p_size": f.lte(3)}, "p_size <= 3")
_filter("filter_between", parts, *_P, {"p_size": f.between(10, 12)}, "p_size BETWEEN 10 AND 12")
_filter("filter_number_array", parts, *_P, {"sizes": f.between(45, 55)}, "p_size BETWEEN 45 AND 55 OR p_size * 2 BETWEEN 45 AND 55")
_filter("filter_boolean_array", parts, *_P, {"flags": f.eq(False)}, "NOT p_size > 25 OR p_size % 2 <> 0")
_filter("filter_eq_enum", documents, "documents", "doc_id", {"lang": f.eq("de")}, "lang = 'de'")
_filter("filter_in_enum", documents, "documents", "doc_id", {"lang": f.in_(["de", "fr", "xx"])}, "lang IN ('de', 'fr')")
_filter("filter_nin_enum", documents, "documents", "doc_id", {"lang": f.nin(["en"])}, "lang NOT IN ('en')")
_W = "string_split(p_name, ' ')"
_filter("filter_contains_all", parts, *_P, {"words": f.contains_all(["red", "ring"])}, f"list_contains({_W}, 'red') AND list_contains({_W}, 'ring')")
_filter("filter_contains_any", parts, *_P, {"words": f.contains_any(["red", "ring"])}, f"list_contains({_W}, 'red') OR list_contains({_W}, 'ring')")
_filter("filter_contains_none", parts, *_P, {"words": f.contains_all([])}, "false")
_filter("filter_string_eq", parts, *_P, {"p_name": f.eq("Red ring")}, f"list_has_any({tok('p_name')}, ['red', 'ring'])")
_filter("filter_string_in", parts, *_P, {"p_name": f.in_(["red x", "ring y"])}, f"list_has_any({tok('p_name')}, ['red', 'ring'])")
_filter("filter_string_array", parts, *_P, {"tags": f.eq("red")}, f"list_contains({_W}, 'red')")
_filter("filter_and", parts, *_P, f.and_({"p_size": f.gt(10)}, {"p_size": f.lt(20)}), "p_size > 10 AND p_size < 20")
_filter("filter_or", parts, *_P, f.or_({"p_size": f.eq(1)}, {"p_size": f.eq(50)}), "p_size = 1 OR p_size = 50")
_filter("filter_not", parts, *_P, f.not_({"p_size": f.gt(10)}), "NOT p_size > 10")
_filter("filter_properties", parts, *_P, {"p_size": f.gt(30), "p_retailprice": f.gt(950), **f.not_({"p_name": f.eq("red")})}, "p_size > 30 AND p_retailprice > 950 AND NOT list_contains(" + tok("p_name") + ", 'red')")

_LABELS = "(SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id) l RIGHT JOIN documents d USING (doc_id)"
_filter("filter_boolean", labelled, _LABELS, "doc_id", {"toxic": f.eq(True)}, "toxic")
_filter("filter_not_missing", labelled, _LABELS, "doc_id", f.not_({"good": f.eq(True)}), "NOT coalesce(good, false)")

# -- geography ---------------------------------------------------------------
_GEO = "(SELECT c_custkey, CAST(c_custkey * 37 % 18000 AS DOUBLE) / 100.0 - 90 AS lat, CAST(c_custkey * 91 % 36000 AS DOUBLE) / 100.0 - 180 AS lon FROM customer)"


def hav(lat: float, lon: float) -> str:
    h = f"(pow(sin((radians(lat) - radians({lat})) / 2), 2) + cos(radians({lat})) * cos(radians(lat)) * pow(sin((radians(lon) - radians({lon})) / 2), 2))"
    return f"(2 * 6371000 * atan2(sqrt({h}), sqrt(1 - {h})))"


_filter("geo_radius_in", customers, _GEO, "c_custkey", {"at": f.geo_radius(48.85, 2.35, 3_000_000)}, f"{hav(48.85, 2.35)} <= 3000000")
_filter("geo_radius_out", customers, _GEO, "c_custkey", {"at": f.geo_radius(48.85, 2.35, 3_000_000, inside=False)}, f"{hav(48.85, 2.35)} > 3000000")
_filter("geo_units", customers, _GEO, "c_custkey", {"at": f.geo_radius(-10, 100, 1500, unit="mi")}, f"{hav(-10, 100)} <= 1500 * 1609.344")
_POLYGON = [GeoPoint(0, 0), GeoPoint(60, 10), GeoPoint(40, 90), GeoPoint(20, 40), GeoPoint(-30, 80)]


def polygon_sql(points: list[GeoPoint]) -> str:
    edges = [f"CAST((({b.lat} > lat) <> ({a.lat} > lat)) AND lon < ({a.lon} - ({b.lon})) * (lat - ({b.lat})) / ({a.lat} - ({b.lat})) + ({b.lon}) AS INT)" for a, b in zip([points[-1], *points], points)]
    return f"(({' + '.join(edges)}) % 2 = 1)"


_filter("geo_polygon_in", customers, _GEO, "c_custkey", {"at": f.geo_polygon(_POLYGON)}, polygon_sql(_POLYGON))
_filter("geo_polygon_out", customers, _GEO, "c_custkey", {"at": f.geo_polygon(_POLYGON, inside=False)}, f"NOT {polygon_sql(_POLYGON)}")


@query(f"SELECT CAST(c_custkey AS VARCHAR) AS id, round(max(d) OVER () - d + 1, 3) AS score FROM (SELECT c_custkey, {hav(48.85, 2.35)} AS d FROM {_GEO}) WHERE d <= 3000000")
def geo_score(spark, sf):
    c = customers(spark, sf)
    return c.ranked(where={"at": f.geo_radius(48.85, 2.35, 3_000_000)}).select(F.col("doc_ord").cast("string").alias("id"), F.round("score", 3).alias("score"))


_A, _F = 6378137.0, 1 / 298.257223563
_B = (1 - _F) * _A
_U = math.atan((1 - _F) * math.tan(math.radians(48.85)))
_VINCENTY = f"""WITH RECURSIVE p AS (SELECT c_custkey AS k, atan((1 - {_F!r}) * tan(radians(lat))) AS u, radians(2.35) - radians(lon) AS span FROM {_GEO} WHERE {{where}}),
r AS (SELECT k, sin(u) AS s1, cos(u) AS c1, span, span AS lam, 0 AS n FROM p
  UNION ALL SELECT k, s1, c1, span, span + (1 - c) * {_F!r} * sa * (sigma + c * ss * (cm + c * cs * (2 * cm * cm - 1))), n + 1 FROM (
    SELECT *, {_F!r} / 16 * c2a * (4 + {_F!r} * (4 - 3 * c2a)) AS c FROM (
      SELECT *, CASE WHEN c2a = 0 THEN 0 ELSE cs - 2 * s1 * {math.sin(_U)!r} / c2a END AS cm FROM (
        SELECT *, 1 - sa * sa AS c2a FROM (SELECT *, c1 * {math.cos(_U)!r} * sin(lam) / ss AS sa, atan2(ss, cs) AS sigma FROM (
          SELECT *, sqrt(pow({math.cos(_U)!r} * sin(lam), 2) + pow(c1 * {math.sin(_U)!r} - s1 * {math.cos(_U)!r} * cos(lam), 2)) AS ss, s1 * {math.sin(_U)!r} + c1 * {math.cos(_U)!r} * cos(lam) AS cs FROM r WHERE n < 40))))) ),
e AS (SELECT *, c2a * {(_A**2 - _B**2) / _B**2!r} AS q, CASE WHEN c2a = 0 THEN 0 ELSE cs - 2 * s1 * {math.sin(_U)!r} / c2a END AS cm FROM (
  SELECT *, 1 - pow(c1 * {math.cos(_U)!r} * sin(lam) / ss, 2) AS c2a, atan2(ss, cs) AS sigma FROM (
    SELECT *, sqrt(pow({math.cos(_U)!r} * sin(lam), 2) + pow(c1 * {math.sin(_U)!r} - s1 * {math.cos(_U)!r} * cos(lam), 2)) AS ss, s1 * {math.sin(_U)!r} + c1 * {math.cos(_U)!r} * cos(lam) AS cs FROM r WHERE n = 40))),
g AS (SELECT *, 1 + q / 16384 * (4096 + q * (-768 + q * (320 - 175 * q))) AS big, q / 1024 * (256 + q * (-128 + q * (74 - 47 * q))) AS small FROM e)
SELECT CAST(k AS VARCHAR) AS id, round({_B!r} * big * (sigma - small * ss * (cm + small / 4 * (cs * (2 * cm * cm - 1) - small / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))), 3) AS metres FROM g"""


@query(f"SELECT * FROM ({_VINCENTY.format(where=hav(48.85, 2.35) + ' <= 3100000')}) WHERE metres <= 3000000")
def geo_vincenty(spark, sf):
    c = customers(spark, sf)
    metres = F.round(geo.vincenty(F.col("at.lat"), F.col("at.lon"), 48.85, 2.35), 3)
    return c.docs.filter(c.where({"at": f.geo_radius(48.85, 2.35, 3_000_000, high_precision=True)})).select("id", metres.alias("metres"))


_CENTRE = geo.centroid(_POLYGON)


@query(f"SELECT CAST(c_custkey AS VARCHAR) AS id, round(max(d) OVER () - d + 1, 3) AS score FROM (SELECT c_custkey, {hav(_CENTRE.lat, _CENTRE.lon)} AS d FROM {_GEO} WHERE {polygon_sql(_POLYGON)})")
def geo_polygon_score(spark, sf):
    """Ranked by the distance from the polygon's centre."""
    return customers(spark, sf).ranked(where={"at": f.geo_polygon(_POLYGON)}).select(F.col("doc_ord").cast("string").alias("id"), F.round("score", 3).alias("score"))


# -- shaping -----------------------------------------------------------------
@query("SELECT CAST(row_number() OVER (ORDER BY doc_id) AS BIGINT) AS rank, CAST(doc_id AS VARCHAR) AS id, 0.0 AS score FROM documents ORDER BY doc_id LIMIT 10")
def match_all(spark, sf):
    return top(documents(spark, sf).search())


@query(bm25_sql("documents", "doc_id", {"text": 1}, starts("erin"), tail="SELECT rank, CAST(id AS VARCHAR) AS id, score FROM (SELECT row_number() OVER (ORDER BY score DESC, id) AS rank, id, score FROM r) WHERE rank BETWEEN 8 AND 12"))
def page_offset_limit(spark, sf):
    return top(documents(spark, sf).search("erin", offset=7, limit=5))


def _sorted(sql_key: str, table: str, key: str, up: bool, limit: int = 50) -> str:
    order = f"{sql_key} {'ASC' if up else 'DESC'} NULLS LAST, {key} {'ASC' if up else 'DESC'}"
    return f"SELECT row_number() OVER (ORDER BY {order}) AS rank, CAST({key} AS VARCHAR) AS id FROM {table} ORDER BY {order} LIMIT {limit}"


def _ranks(result) -> DataFrame:
    return result.hits.select(F.col("rank").cast("long").alias("rank"), "id")


@query(_sorted("p_retailprice", "part", "p_partkey", False))
def sort_num_desc(spark, sf):
    return _ranks(parts(spark, sf).search(sort_by=SortBy("p_retailprice", SortOrder.DESC), limit=50))


@query(_sorted(f"translate(lower(p_name), '{_FROM}', '{_TO}')", "part", "p_partkey", True))
def sort_string(spark, sf):
    return _ranks(parts(spark, sf).search(sort_by=SortBy("p_name"), limit=50))


@query(_sorted("good", _LABELS, "doc_id", False, 500))
def sort_missing_last(spark, sf):
    return _ranks(labelled(spark, sf).search(sort_by=SortBy("good", SortOrder.DESC), limit=500))


@query(f"SELECT doc_id, translate(replace(replace(replace(replace(lower(text), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), '{_FROM}', '{_TO}') AS key FROM documents WHERE lang = 'de'")
def sort_key_de(spark, sf):
    return _t(spark, sf, "documents").filter("lang = 'de'").select("doc_id", sort_key(F.col("text"), "german").alias("key"))


def _facet(result, path: str) -> DataFrame:
    return result.facets[path].values.select("value", "count")


_ERIN = "SELECT doc_id AS id FROM documents WHERE len(list_filter(" + tok("text") + ", lambda x: starts_with(x, 'erin'))) > 0"


def _facet_docs(spark, sf) -> Collection:
    return Collection.of(_t(spark, sf, "documents"), {"text": "string", "source": "string", "lang": "enum", "n_chars": "number"}, "doc_id")


def _facet_sql(order: str, offset: int, limit: int) -> str:
    return f"SELECT source AS value, count(*) AS count FROM documents WHERE doc_id IN ({_ERIN}) GROUP BY source ORDER BY count(*) {order}, source LIMIT {limit - offset} OFFSET {offset}"


@query(_facet_sql("DESC", 0, 10))
def facet_string_desc(spark, sf):
    return _facet(_facet_docs(spark, sf).search("erin", properties=["text"], facets={"source": FacetConfig()}), "source")


@query(_facet_sql("ASC", 0, 10))
def facet_string_asc(spark, sf):
    return _facet(_facet_docs(spark, sf).search("erin", properties=["text"], facets={"source": FacetConfig(sort=FacetSorting.ASC)}), "source")


@query(_facet_sql("DESC", 2, 6))
def facet_string_slice(spark, sf):
    return _facet(_facet_docs(spark, sf).search("erin", properties=["text"], facets={"source": FacetConfig(offset=2, limit=6)}), "source")


@query(f"SELECT lang AS value, count(*) AS count FROM documents WHERE doc_id IN ({_ERIN}) GROUP BY lang")
def facet_enum(spark, sf):
    return _facet(_facet_docs(spark, sf).search("erin", properties=["text"], facets={"lang": FacetConfig()}), "lang")


@query(f"SELECT CAST(toxic AS VARCHAR) AS value, count(*) AS count FROM {_LABELS} WHERE toxic IS NOT NULL GROUP BY toxic")
def facet_bool(spark, sf):
    return _facet(labelled(spark, sf).search(facets={"toxic": FacetConfig()}), "toxic")


@query(f"SELECT value, count(*) AS count FROM (SELECT unnest(list_distinct({_W})) AS value FROM part WHERE p_size > 25) GROUP BY value")
def facet_array(spark, sf):
    return _facet(parts(spark, sf).search(where={"p_size": f.gt(25)}, facets={"words": FacetConfig()}), "words")


@query("SELECT unnest(['0-1000', '1000-5000', '4000-100000']) AS value, unnest([count(*) FILTER (WHERE n_chars BETWEEN 0 AND 1000), count(*) FILTER (WHERE n_chars BETWEEN 1000 AND 5000), count(*) FILTER (WHERE n_chars BETWEEN 4000 AND 100000)]) AS count FROM documents")
def facet_ranges(spark, sf):
    ranges = (NumberFacetRange(0, 1000), NumberFacetRange(1000, 5000), NumberFacetRange(4000, 100000))
    return _facet(documents(spark, sf).search(facets={"n_chars": FacetConfig(ranges=ranges)}), "n_chars")


@query("SELECT count(DISTINCT source) AS count FROM documents")
def facet_count(spark, sf):
    return _facet_docs(spark, sf).search(facets={"source": FacetConfig(limit=2)}).facets["source"].count


@query("SELECT unnest(['10-20', '30-60']) AS value, unnest([count(*) FILTER (WHERE p_size BETWEEN 10 AND 20 OR p_size * 2 BETWEEN 10 AND 20), count(*) FILTER (WHERE p_size BETWEEN 30 AND 60 OR p_size * 2 BETWEEN 30 AND 60)]) AS count FROM part")
def facet_number_array(spark, sf):
    return _facet(parts(spark, sf).search(facets={"sizes": FacetConfig(ranges=(NumberFacetRange(10, 20), NumberFacetRange(30, 60)))}), "sizes")


@query("SELECT CAST(v AS VARCHAR) AS value, count(*) AS count FROM (SELECT unnest(list_distinct([p_size > 25, p_size % 2 = 0])) AS v FROM part) GROUP BY v")
def facet_boolean_array(spark, sf):
    return _facet(parts(spark, sf).search(facets={"flags": FacetConfig()}), "flags")


@query("SELECT source, k - 1 AS index, CAST(doc_id AS VARCHAR) AS id, 0.0 AS score FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE k <= 3")
def group_single_limit(spark, sf):
    r = labelled(spark, sf).search(group_by=GroupBy(("source",), limit=3))
    return r.groups.select("source", F.col("index").cast("long").alias("index"), "id", "score")


@query(f"""WITH k AS (SELECT doc_id, lang, toxic, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS a, row_number() OVER (PARTITION BY toxic ORDER BY doc_id) AS b FROM {_LABELS})
SELECT lang, toxic, row_number() OVER (PARTITION BY lang, toxic ORDER BY doc_id) - 1 AS index, CAST(doc_id AS VARCHAR) AS id FROM k WHERE a <= 40 AND b <= 40 AND toxic IS NOT NULL""")
def group_multi(spark, sf):
    r = labelled(spark, sf).search(group_by=GroupBy(("lang", "toxic"), limit=40))
    return r.groups.select("lang", "toxic", F.col("index").cast("long").alias("index"), "id")


@query("SELECT o_orderstatus, string_agg(CAST(o_orderkey AS VARCHAR), '>' ORDER BY o_orderkey) AS value FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS k FROM orders) WHERE k <= 5 GROUP BY o_orderstatus")
def group_reduce(spark, sf):
    chain = GroupReduce(lambda values, acc, hit, k: f"{acc}>{hit['id']}" if k else hit["id"], lambda n: "", "string")
    return orders(spark, sf).search(group_by=GroupBy(("o_orderstatus",), limit=5, reduce=chain)).groups


# -- changes -----------------------------------------------------------------
@query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_name FROM part WHERE p_partkey NOT IN (1, 2, 3)")
def crud_remove(spark, sf):
    return parts(spark, sf).remove("1", "2", "3", "none").docs.select("id", "p_name")


@query("SELECT CAST(p_partkey AS VARCHAR) AS id FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size % 7 = 0)")
def crud_remove_all(spark, sf):
    gone = _t(spark, sf, "part").filter("p_size % 7 = 0").select(F.col("p_partkey").cast("string").alias("id"))
    return parts(spark, sf).remove_all(gone).docs.select("id")


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_name, CAST(p_size AS DOUBLE) AS p_size FROM part WHERE p_partkey = 7")
def get_by_id(spark, sf):
    return parts(spark, sf).get("7").select("id", "p_name", "p_size")


def _names(spark, sf) -> Collection:
    """Part names of a collection made by bulk inserts of frames: of some parts, then of the rest."""
    rows = _t(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), "p_name", F.col("p_size").cast("double").alias("p_size"))
    return Collection.create(spark, {"p_name": "string", "p_size": "number"}, score_digits=6).insert(rows.filter("p_size > 25")).insert(rows.filter("p_size <= 25"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_name, CAST(p_size AS DOUBLE) AS p_size FROM part")
def insert_bulk(spark, sf):
    return _names(spark, sf).docs.select("id", "p_name", "p_size")


@query("SELECT CAST(count(*) AS BIGINT) AS docs, false AS empty, true AS cleared FROM part")
def count_and_clear(spark, sf):
    c = _names(spark, sf)
    return spark.createDataFrame([(c.count(), c.is_empty(), c.clear().is_empty())], "docs long, empty boolean, cleared boolean")


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_name FROM part WHERE p_size % 2 = 0 UNION ALL SELECT 'x' || p_partkey, upper(p_name) FROM part WHERE p_size % 2 = 1")
def update_bulk(spark, sf):
    c = _names(spark, sf)
    odd = _t(spark, sf, "part").filter("p_size % 2 = 1")
    gone = odd.select(F.col("p_partkey").cast("string").alias("id"))
    new = odd.select(F.concat(F.lit("x"), F.col("p_partkey").cast("string")).alias("id"), F.upper("p_name").alias("p_name"), F.col("p_size").cast("double").alias("p_size"))
    return c.update(gone, new).docs.select("id", "p_name")


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_name, CAST(p_size AS DOUBLE) AS p_size FROM part WHERE p_partkey <> 1 UNION ALL SELECT 'new', 'other name', 3.0")
def crud_update(spark, sf):
    return parts(spark, sf).update(["1"], [{"id": "new", "p_name": "other name", "p_size": 3}]).docs.select("id", "p_name", "p_size")


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey = 5 THEN 'patched' ELSE p_name END AS p_name, CASE WHEN p_partkey <> 5 THEN CAST(p_size AS DOUBLE) END AS p_size FROM part")
def crud_patch(spark, sf):
    return parts(spark, sf).patch("5", {"p_name": "patched", "p_size": None}).docs.select("id", "p_name", "p_size")


@query(SQL["qps_search"])
def reindex(spark, sf):
    c = documents(spark, sf).reindex("qps")
    return every(c, c.ranked("erin anthe"))


# -- highlighting ------------------------------------------------------------
@query("""SELECT doc_id, CAST(i AS INTEGER) AS start FROM (SELECT doc_id, lower(text) AS t, unnest(range(0, length(text) - 3)) AS i FROM documents) WHERE substr(t, CAST(i AS INT) + 1, 4) = 'erin'""")
def highlight_positions(spark, sf):
    docs = _t(spark, sf, "documents").select("doc_id", highlight.positions(F.col("text"), "erin").alias("m"))
    return docs.select("doc_id", F.explode("m").alias("p")).select("doc_id", F.col("p.start").alias("start"))


@query("""SELECT doc_id, CAST(i AS INTEGER) AS start FROM (SELECT doc_id, lower(text) AS t, unnest(range(0, length(text) - 4)) AS i FROM documents) WHERE substr(t, CAST(i AS INT) + 1, 5) = 'latha'
AND NOT regexp_matches(CASE WHEN i > 0 THEN substr(t, CAST(i AS INT), 1) ELSE '' END, '[\\p{L}0-9_]') AND NOT regexp_matches(substr(t, CAST(i AS INT) + 6, 1), '[\\p{L}0-9_]')""")
def highlight_whole_words(spark, sf):
    docs = _t(spark, sf, "documents").select("doc_id", highlight.positions(F.col("text"), "latha", whole_words=True).alias("m"))
    return docs.select("doc_id", F.explode("m").alias("p")).select("doc_id", F.col("p.start").alias("start"))


@query("""WITH m AS (SELECT doc_id, text, strpos(lower(text), 'erin') - 1 AS s, length(text) AS n FROM documents), c AS (SELECT *, (s + s + 4) // 2 - 30 AS a FROM m), e AS (
SELECT *, greatest(a, 0) AS b FROM c), k AS (SELECT *, least(b + 60, n) AS z FROM e), w AS (SELECT *, greatest(least(b, z - 60), 0) AS y FROM k)
SELECT doc_id, CASE WHEN s < 0 OR n <= 60 THEN text ELSE CASE WHEN y > 0 THEN '...' ELSE '' END || substr(text, y + 1, 60) || CASE WHEN z < n THEN '...' ELSE '' END END AS excerpt FROM w""")
def excerpt(spark, sf):
    docs = _t(spark, sf, "documents").withColumn("m", highlight.positions(F.col("text"), "erin"))
    return docs.select("doc_id", highlight.excerpt(F.col("text"), F.col("m"), 60).alias("excerpt"))

