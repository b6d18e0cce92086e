"""Index tables as lazy DataFrames: postings with lengths in the row, vocabulary, and length statistics.

Term frequencies and lengths are computed inside each document's row, before anything is exploded, so building
postings needs no shuffle and no aggregation: repeats of a word are runs of its document's sorted tokens.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import Tokenizer
from ..types import Algorithm

BUCKET = 1 << 16
#: a table of at most so many bytes in fewer files than there are cores is dealt out to all of them
SPREAD_BYTES = 512 << 20
#: frames kept by searches that are still cached; older ones are released
KEPT: deque[DataFrame] = deque()
KEEP = 16


def keep(df: DataFrame) -> DataFrame:
    """Cache a small frame that several plans of one search read. The oldest of more than ``KEEP`` is released; it would be computed again."""
    df = df.persist()
    KEPT.append(df)
    while len(KEPT) > KEEP:
        KEPT.popleft().unpersist()
    return df


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` (with ``doc_ord``) in as many parts as there are cores, where a small table comes in fewer files."""
    files, cores = len(rows.inputFiles()), rows.sparkSession.sparkContext.defaultParallelism
    if not 0 < files < cores:
        return rows
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return rows.repartition(cores, "doc_ord") if size <= SPREAD_BYTES else rows


def position(n: Column, total: Column) -> Column:
    """PT15's slot of token ``n`` of ``total``."""
    return F.when(total < 15, n).otherwise(F.floor(n * 15 / total).cast("int")).cast("int")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def tokens_of(docs: DataFrame, prop: str, tokenizer: Tokenizer, array: bool = False) -> Column:
    c = F.col(prop)
    if not array:
        return tokenizer.column(c, prop)
    return F.flatten(F.transform(F.filter(c, lambda x: x.isNotNull()), lambda x: tokenizer.column(x, prop)))


def _runs(sorted_: Column, word: Callable[[Column], Column], make: Callable[[Column, Column, Column], Column]) -> Column:
    """``make(all, place, length)`` for each run of equal words in one sorted array. Arrays bound by lambdas are made once, not for each element."""

    def of(s: Column) -> Column:
        firsts = F.filter(F.transform(s, lambda x, i: F.when(~word(x).eqNullSafe(word(F.get(s, i - 1))), i)), lambda i: i.isNotNull())
        return F.flatten(F.transform(F.array(firsts), lambda at: F.transform(at, lambda i, k: make(s, i, F.coalesce(F.get(at, k + 1), F.size(s)) - i))))

    return F.flatten(F.transform(F.array(sorted_), of))


def _counted(tokens: Column, n_tokens: Column) -> Column:
    """``word, tf`` of the words of one document's tokens, which may repeat."""
    return _runs(F.sort_array(tokens), lambda w: w, lambda s, i, n: F.struct(F.get(s, i).alias("word"), (n / n_tokens).alias("tf")))


def bm25_postings(docs: DataFrame, props: list[str], tokenizer: Tokenizer, arrays: frozenset[str] = frozenset()) -> DataFrame:
    """``prop, word, doc_ord, tf, n_tokens``."""
    parts = []
    for p in props:
        repeats = tokenizer.allow_duplicates or p in arrays
        rows = spread(docs.filter(F.col(p).isNotNull()).select("doc_ord", F.col(p)))
        rows = rows.select("doc_ord", tokens_of(rows, p, tokenizer, p in arrays).alias("tokens")).withColumn("n_tokens", F.size("tokens"))
        if repeats:
            rows = rows.select("doc_ord", "n_tokens", F.inline(_counted(F.col("tokens"), F.col("n_tokens"))))
        else:
            # of a plain explode Spark would filter by the array's size before the text is split, and split it once more for that
            rows = rows.select("doc_ord", "n_tokens", (F.lit(1.0) / F.col("n_tokens")).alias("tf"), F.explode_outer("tokens").alias("word")).filter("word IS NOT NULL")
        parts.append(rows.select(F.lit(p).alias("prop"), "word", "doc_ord", "tf", "n_tokens"))
    return _union(parts)


@dataclass
class Stats:
    documents: int
    average: dict[str, float]


def bm25_matches(docs: DataFrame, props: list[str], tokenizer: Tokenizer, arrays: frozenset[str], test: Callable[[Column], Column], whole: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame, Stats]:
    """Postings of the words that pass ``test``, their ``prop, word, df``, and the length statistics, from one reading of the documents.

    What is kept for all is a small row for each document: its lengths and its matching tokens. With ``whole``, postings are only of
    documents that have a property whose words pass it; frequencies and statistics are of all documents still.
    """
    rows = spread(docs.select("doc_ord", *(F.col(p).alias(f"p{k}") for k, p in enumerate(props))))
    tokens = [F.when(F.col(f"p{k}").isNotNull(), tokens_of(rows, f"p{k}", _renamed(tokenizer, p, f"p{k}"), p in arrays)).alias(f"t{k}") for k, p in enumerate(props)]
    rows = rows.select("doc_ord", *tokens)
    rows = rows.select("doc_ord", *(F.when(F.col(f"t{k}").isNotNull(), F.size(f"t{k}")).alias(f"n{k}") for k in range(len(props))), *(F.filter(f"t{k}", test).alias(f"m{k}") for k in range(len(props))))
    if whole is not None:
        passed = reduce(lambda a, b: a | b, [F.coalesce(whole(F.col(f"m{k}")), F.lit(False)) for k in range(len(props))])
        rows = rows.withColumn("whole", passed)
    rows = keep(rows)
    parts, words = [], []
    for k, p in enumerate(props):
        hits, n = rows.filter(F.size(f"m{k}") > 0), F.col(f"n{k}")
        once = F.array_distinct(f"m{k}") if tokenizer.allow_duplicates or p in arrays else F.col(f"m{k}")
        words.append(hits.select(F.lit(p).alias("prop"), F.explode(once).alias("word")))
        if whole is not None:
            hits = hits.filter("whole")
        if tokenizer.allow_duplicates or p in arrays:
            hits = hits.select("doc_ord", n.alias("n_tokens"), F.inline(_counted(F.col(f"m{k}"), n)))
        else:
            hits = hits.select("doc_ord", n.alias("n_tokens"), F.explode(f"m{k}").alias("word"), (F.lit(1.0) / n).alias("tf"))
        parts.append(hits.select(F.lit(p).alias("prop"), "word", "doc_ord", "tf", "n_tokens"))
    return _union(parts), _union(words).groupBy("prop", "word").agg(F.count("*").alias("df")), _stats(rows, props)


def _renamed(tokenizer: Tokenizer, prop: str, name: str) -> Tokenizer:
    """A tokenizer that treats ``name`` as it does ``prop``."""
    move = lambda names: frozenset({name}) if prop in names else frozenset()
    return replace(tokenizer, skip=move(tokenizer.skip), stem_skip=move(tokenizer.stem_skip)) if tokenizer.skip or tokenizer.stem_skip else tokenizer


def _quanta(sentences: Column, test: Callable[[Column], Column] | None) -> Column:
    """``word, q`` of the tokens of one text's sentences. A sentence of more than one token ends a quantum; only the first 19 ends matter."""
    ends = F.slice(F.filter(F.transform(sentences, lambda s, i: F.when(F.size(s) > 1, i)), lambda i: i.isNotNull()), 1, 19)
    each = F.transform(sentences, lambda s, i: F.struct((s if test is None else F.filter(s, test)).alias("w"), F.size(F.filter(ends, lambda e: e < i)).alias("q")))
    return F.flatten(F.transform(each, lambda e: F.transform(e["w"], lambda t: F.struct(t.alias("word"), e["q"].alias("q")))))


def _occurrences(s: Column, i: Column, n: Column) -> Column:
    bit = lambda t: F.call_function("shiftleft", F.lit(1), t["q"])
    return F.struct(F.get(s, i)["word"].alias("word"), n.alias("occ"), F.aggregate(F.slice(s, i + 1, n), F.lit(0), lambda m, t: m.bitwiseOR(bit(t))).alias("mask"))


def qps_postings(docs: DataFrame, props: list[str], tokenizer: Tokenizer, arrays: frozenset[str] = frozenset(), test: Callable[[Column], Column] | None = None) -> DataFrame:
    """``prop, word, doc_ord, occ, mask, n_tokens``: occurrences by sentence, and a 20-bit mask of sentences. With ``test``, of the words
    that pass it only."""
    parts = []
    for p in props:
        elements = F.filter(F.col(p), lambda x: x.isNotNull()) if p in arrays else F.array(F.col(p))
        rows = spread(docs.filter(F.col(p).isNotNull()).select("doc_ord", F.col(p)))
        rows = rows.select("doc_ord", F.transform(elements, lambda text: F.transform(F.split(text, "[.?!]"), lambda s: tokenizer.column(s, p))).alias("s"))
        n = F.aggregate(F.flatten("s"), F.lit(0), lambda a, s: a + F.size(s))
        placed = F.sort_array(F.flatten(F.transform("s", lambda s: _quanta(s, test))))
        rows = rows.select("doc_ord", n.alias("n_tokens"), F.inline(_runs(placed, lambda t: t["word"], _occurrences)))
        parts.append(rows.select(F.lit(p).alias("prop"), "word", "doc_ord", "occ", "mask", "n_tokens"))
    return _union(parts)


def pt15_postings(docs: DataFrame, props: list[str], tokenizer: Tokenizer, arrays: frozenset[str] = frozenset(), test: Callable[[Column], Column] | None = None) -> DataFrame:
    """``prop, word, doc_ord, bucket, n_tokens``; prefixes of words stay virtual. With ``test``, of the words that pass it only."""
    parts = []
    for p in props:
        rows = spread(docs.filter(F.col(p).isNotNull()).select("doc_ord", F.col(p)))
        if p in arrays:
            rows = rows.select("doc_ord", F.explode(p).alias("e")).filter("e IS NOT NULL").select("doc_ord", tokenizer.column(F.col("e"), p).alias("tokens"))
        else:
            rows = rows.select("doc_ord", tokenizer.column(F.col(p), p).alias("tokens"))
        rows = rows.withColumn("n_tokens", F.size("tokens"))
        if test is None:
            rows = rows.select("doc_ord", "n_tokens", F.posexplode("tokens").alias("n", "word"))
        else:
            placed = F.filter(F.transform("tokens", lambda t, i: F.when(test(t), F.struct(i.alias("n"), t.alias("word")))), lambda x: x.isNotNull())
            rows = rows.select("doc_ord", "n_tokens", F.inline(placed))
        parts.append(rows.select(F.lit(p).alias("prop"), "word", "doc_ord", (14 - position(F.col("n"), F.col("n_tokens"))).alias("bucket"), "n_tokens"))
    return _union(parts)


BUILDERS = {Algorithm.BM25: bm25_postings, Algorithm.QPS: qps_postings, Algorithm.PT15: pt15_postings}


def vocabulary(postings: DataFrame) -> DataFrame:
    """``prop, word, df``. Only PT15's postings can hold a word of a document twice."""
    once = "n_tokens" in postings.columns and "bucket" not in postings.columns
    return postings.groupBy("prop", "word").agg((F.count("*") if once else F.countDistinct("doc_ord")).alias("df"))


def length_stats(docs: DataFrame, props: list[str], tokenizer: Tokenizer, arrays: frozenset[str] = frozenset()) -> Stats:
    """Number of documents, and the running average length of each property.

    Where every document has the property the running average is the mean. Else document ``i`` of those that have it
    weighs ``1/i`` times the product of ``(j-1)/j`` over later ones, ``j`` counting all documents; logarithms of that
    product are prefix sums, taken in buckets of the document order.
    """
    if not props:
        return Stats(docs.count(), {})
    rows = spread(docs.select("doc_ord", *(F.col(p).alias(f"p{k}") for k, p in enumerate(props))))
    sizes = [F.when(F.col(f"p{k}").isNotNull(), F.size(tokens_of(rows, f"p{k}", _renamed(tokenizer, p, f"p{k}"), p in arrays))) for k, p in enumerate(props)]
    return _stats(rows.select("doc_ord", *(c.alias(f"n{k}") for k, c in enumerate(sizes))), props)


def saved_stats(docs: DataFrame, props: list[str], postings: DataFrame, tokenizer: Tokenizer, arrays: frozenset[str]) -> Stats:
    """:func:`length_stats` from BM25 postings that are written already, without splitting the texts again where every document has the property."""
    row = docs.agg(F.count("*").alias("all"), *(F.count(p).alias(f"c{k}") for k, p in enumerate(props))).first()
    if any(row[f"c{k}"] not in (0, row["all"]) for k in range(len(props))):
        return length_stats(docs, props, tokenizer, arrays)
    sums = {r["prop"]: r["n"] for r in postings.groupBy("prop").agg(F.sum(F.round(F.col("tf") * F.col("n_tokens")).cast("long")).alias("n")).collect()}
    return Stats(row["all"], {p: sums.get(p, 0) / row[f"c{k}"] if row[f"c{k}"] else 0.0 for k, p in enumerate(props)})


def _stats(rows: DataFrame, props: list[str]) -> Stats:
    row = rows.agg(F.count("*").alias("all"), *(f(f"n{k}").alias(f"{name}{k}") for k in range(len(props)) for name, f in (("c", F.count), ("s", F.sum)))).first()
    out = {}
    for k, p in enumerate(props):
        have, total = row[f"c{k}"], row[f"s{k}"]
        if have in (0, row["all"]):
            out[p] = total / have if have else 0.0
        else:
            out[p] = _running(rows.select("doc_ord", F.col(f"n{k}").alias("n")))
    return Stats(row["all"], out)


def _running(rows: DataFrame) -> float:
    bucket = F.floor(F.col("doc_ord") / BUCKET)
    rows = rows.withColumn("bucket", bucket)
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("bucket").agg(F.count("*").alias("c")).withColumn("base", F.coalesce(F.sum("c").over(before), F.lit(0)))
    placed = rows.join(F.broadcast(sums) if sums.count() < 1_000_000 else sums, "bucket")
    placed = placed.withColumn("i", F.col("base") + F.row_number().over(Window.partitionBy("bucket").orderBy("doc_ord")))
    placed = placed.filter("n IS NOT NULL").withColumn("l", F.when(F.col("i") > 1, F.log((F.col("i") - 1) / F.col("i"))).otherwise(0.0))
    logs = placed.groupBy("bucket").agg(F.sum("l").alias("s")).withColumn("sofar", F.coalesce(F.sum("s").over(before), F.lit(0.0)))
    logs = logs.select("bucket", "sofar")
    placed = placed.drop("base", "c").join(logs, "bucket")
    inside = F.sum("l").over(Window.partitionBy("bucket").orderBy("doc_ord").rowsBetween(Window.unboundedPreceding, 0))
    placed = placed.withColumn("p", F.col("sofar") + inside)
    last = placed.agg(F.min("p")).first()[0]
    return placed.agg(F.sum(F.col("n") / F.col("i") * F.exp(F.lit(last) - F.col("p")))).first()[0]
