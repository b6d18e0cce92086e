"""Ranking plans: from query tokens and postings to ``doc_ord, score`` with how each document matched."""

from __future__ import annotations

import math
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions.text import within
from ..types import Algorithm, BM25Params
from .index import Stats


def bm25(tf: Column, matching: Column, documents, length: Column, average, params: BM25Params = BM25Params()) -> Column:
    n = matching.cast("double")
    idf = F.log(1 + (F.lit(float(documents)) - n + 0.5) / (n + 0.5))
    return idf * (params.d + tf * (params.k + 1)) / (tf + params.k * (1 - params.b + params.b * length / average))


def matches(word: Column, token: str, exact: bool, tolerance: int) -> Column:
    """Whether an indexed word answers a query token: equal, within an edit distance, or beginning with it."""
    if exact:
        return word == token
    if tolerance:
        return within(F.lit(token), word, tolerance)
    return F.startswith(word, F.lit(token)) if token else F.lit(True)


def check_boost(boost: Mapping[str, float], props: list[str]) -> None:
    for p in props:
        if boost.get(p, 1.0) <= 0:
            raise QueryError(f"boost of {p!r} must be above 0")


def _by_prop(values: Mapping[str, float], props: list[str]) -> Column:
    out = F.lit(float(values.get(props[-1], 1.0)))
    for p in props[:-1]:
        out = F.when(F.col("prop") == p, float(values.get(p, 1.0))).otherwise(out)
    return out


#: tokens that one mask column takes
MASK = 63


#: from so many tokens of one length on, a word's beginning is looked up in a set
SET = 11


def answers(tokens: list[str], exact: bool, tolerance: int):
    """A test of words: whether any token is answered."""

    def test(word: Column) -> Column:
        if exact:
            return word.isin(tokens)
        near = [within(F.lit(t), word, tolerance) for t in tokens if t] if tolerance else []
        return reduce(lambda a, b: a | b, [*_begins(word, tokens), *near])

    return test


def _by_length(tokens: list[str]) -> dict[int, list[str]]:
    out: dict[int, list[str]] = {}
    for t in dict.fromkeys(tokens):
        out.setdefault(len(t), []).append(t)
    return out


def _begins(word: Column, tokens: list[str]) -> list[Column]:
    """Tests whether a word begins with any token. Few tokens stay comparisons that reach a scan."""
    out = []
    for n, some in _by_length(tokens).items():
        out += [F.substring(word, 1, n).isin(some)] if len(some) >= SET and n else [matches(word, t, False, 0) for t in some]
    return out


def whole(tokens: list[str], exact: bool, tolerance: int):
    """A test of the array of a document's words: whether every token is answered."""

    def has(words: Column, t: str) -> Column:
        return F.exists(words, lambda w: matches(w, t, exact, tolerance))

    def have(words: Column, n: int, some: list[str]) -> Column:
        begins = words if exact else F.transform(words, lambda w: F.substring(w, 1, n))
        # a word answers one token of a length at most, so that short documents fail at once
        return (F.size(words) >= len(some)) & (F.size(F.array_intersect(begins, F.array(*map(F.lit, some)))) == len(some))

    def test(words: Column) -> Column:
        out = []
        for n, some in ({0: list(dict.fromkeys(tokens))} if exact else _by_length(tokens)).items():
            out += [has(words, t) for t in some] if len(some) < SET or tolerance else [have(words, n, some)]
        return reduce(lambda a, b: a & b, out)

    return test


def found(postings: DataFrame, props: list[str], tokens: list[str], exact: bool, tolerance: int) -> DataFrame:
    """Postings whose word answers a token; ``hits``: of how many tokens, ``bits0, bits1, ...``: of which, ``MASK`` in each."""
    tests = [matches(F.col("word"), t, exact, tolerance) for t in tokens]
    rows = postings.filter(F.col("prop").isin(props) & answers(tokens, exact, tolerance)(F.col("word")))
    hits = reduce(lambda a, b: a + b, [F.when(t, 1).otherwise(0) for t in tests])
    rows = rows.withColumn("hits", hits)
    for w, first in enumerate(range(0, len(tests), MASK)):
        some = [F.when(t, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")) for k, t in enumerate(tests[first : first + MASK])]
        rows = rows.withColumn(f"bits{w}", reduce(lambda a, b: a.bitwiseOR(b), some))
    return rows


def rank_bm25(postings: DataFrame, vocab: DataFrame | None, stats: Stats, props, tokens, *, exact, tolerance, boost, threshold, allowed: DataFrame | None, params: BM25Params, strict: bool, complete: bool = False) -> DataFrame:
    """``complete``: all ``postings`` are of documents with every token in one property."""
    check_boost(boost, props)
    rows = postings.filter(F.col("prop").isin(props) & answers(tokens, exact, tolerance)(F.col("word")))
    # document frequencies count all documents, whatever the filter; partial aggregation, then a small join
    df = rows.groupBy("prop", "word").agg(F.count("*").alias("df")) if vocab is None else vocab
    # which tokens it answers is found once for each word; every word of ``rows`` is among them
    words = found(df, props, tokens, exact, tolerance)
    if allowed is not None:
        rows = rows.join(allowed, "doc_ord", "left_semi")
    rows = rows.join(words, ["prop", "word"], "left")
    one = bm25(F.col("tf"), F.col("df"), stats.documents, F.col("n_tokens"), _by_prop(stats.average, props), params)
    rows = rows.withColumn("s", one * _by_prop(boost, props) * F.col("hits"))
    if threshold >= 1 or len(tokens) == 1 or complete:
        return rows.groupBy("doc_ord").agg(F.sum("s").alias("score"))
    masks = [c for c in rows.columns if c.startswith("bits")]
    by_prop = rows.groupBy("doc_ord", "prop").agg(F.sum("s").alias("s"), F.sum("hits").alias("hits"), *(F.bit_or(m).alias(m) for m in masks))
    full = F.max(F.col("hits") == len(tokens)) if strict else F.max(reduce(lambda a, b: a + b, [F.bit_count(m) for m in masks]) >= len(tokens))
    ranked = by_prop.groupBy("doc_ord").agg(F.sum("s").alias("score"), full.alias("full"))
    if threshold <= 0:
        return ranked.filter("full").select("doc_ord", "score")
    counts = ranked.agg(F.sum(F.col("full").cast("int")).alias("f"), F.count("*").alias("n")).first()
    whole, rest = counts["f"] or 0, counts["n"] - (counts["f"] or 0)
    if not whole:
        return ranked.select("doc_ord", "score")
    more = ranked.filter(~F.col("full")).orderBy(F.desc("score"), "doc_ord").limit(math.ceil(rest * threshold))
    return ranked.filter("full").unionByName(more).select("doc_ord", "score")


def rank_qps(postings: DataFrame, props, tokens, *, exact, tolerance, boost, allowed) -> DataFrame:
    """Words count once however many tokens they answer. Sentence bits that a later word shares with earlier ones give 2
    each; over all words that is the bits in total less the distinct ones, in any order."""
    check_boost(boost, props)
    rows = found(postings, props, tokens, exact, tolerance)
    if allowed is not None:
        rows = rows.join(allowed, "doc_ord", "left_semi")
    base = (F.col("occ") * F.col("occ") / F.col("n_tokens") + F.when(F.col("word").isin(tokens), 1).otherwise(0)) * _by_prop(boost, props)
    near = F.sum(F.bit_count("mask")) - F.bit_count(F.bit_or("mask"))
    return rows.groupBy("doc_ord").agg((F.sum(base) + 2 * near).alias("score"))


def rank_pt15(postings: DataFrame, props, tokens, *, exact, tolerance, boost, allowed) -> DataFrame:
    if exact or tolerance:
        raise QueryError("PT15 takes neither exact nor tolerance")
    check_boost(boost, props)
    rows = found(postings, props, tokens, False, 0)
    if allowed is not None:
        rows = rows.join(allowed, "doc_ord", "left_semi")
    return rows.groupBy("doc_ord").agg(F.sum(F.col("bucket") * F.col("hits") * _by_prop(boost, props)).alias("score"))


def rank(algorithm: Algorithm, postings, vocab, stats, props, tokens, **options) -> DataFrame:
    if algorithm is Algorithm.BM25:
        return rank_bm25(postings, vocab, stats, props, tokens, **options)
    own = {k: options[k] for k in ("exact", "tolerance", "boost", "allowed")}
    return (rank_qps if algorithm is Algorithm.QPS else rank_pt15)(postings, props, tokens, **own)


def prioritize(lists: list[list[tuple[int, float]]], boost: float, keywords: int, threshold: float = 1.0) -> list[tuple[int, float]]:
    """Merge scored lists on the driver: a document met again gains its new score times 1.5; then the threshold applies."""
    if not boost:
        raise QueryError("boost must not be 0")
    total: dict[int, float] = {}
    seen: dict[int, int] = {}
    for one in lists:
        for doc, score in one:
            s = score * boost
            total[doc] = (total[doc] * 1.5 + s) if doc in total else s
            seen[doc] = seen.get(doc, 0) + 1
    ranked = sorted(total.items(), key=lambda x: (-x[1], x[0]))
    if threshold >= 1 or keywords <= 1:
        return ranked
    full = [x for x in ranked if seen[x[0]] >= keywords]
    rest = [x for x in ranked if seen[x[0]] < keywords]
    return full + rest[: math.ceil(len(rest) * threshold)] if full else ranked
