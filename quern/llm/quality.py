"""Quality classifier: a sparse ensemble of rules, compiled into Spark columns.

Statistics of a text are Spark expressions. Small boosted trees are grown on a bounded sample of labelled rows; every
path from a root is a conjunctive rule. A logistic model with an L1 penalty weighs the rules and drops most. What
remains becomes one column expression, so that scoring stays in the JVM and reads every text once.

Defined cases: labels are used where ``quality`` is 0 or 1 and all rows of a ``doc_id`` agree; null ids aren't used; with labels
of one class (or none) the score is that class's share (1.0 with none); a null, empty or blank text scores 0.0 and is
rejected; whole texts count, however long; repeated rows score alike, and ``keep_good`` carries other columns along whatever their names;
an empty table gives no rows. Labels of toxicity aren't looked at: the statistics of a text don't tell it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: labelled rows used for training at most; they are those with the smallest MD5 of their id
SAMPLE = 12_000
KEEP_AT = 0.5
TREES, DEPTH, BINS = 24, 3, 32
L1 = 0.002

FEATURES = ["chars", "words", "word_length", "distinct", "symbols", "marks", "pipes", "bangs", "upper", "digits", "stops", "commas", "lines", "twins"]


def statistics(text: Column) -> tuple[Column, list[Column]]:
    """The array of words, and the features given columns ``t`` (text) and ``w`` (words)."""
    t, w = F.col("t"), F.col("w")
    chars = F.length(t).cast("double")
    n = F.size(w).cast("double")
    per_char = lambda rx: F.regexp_count(t, F.lit(rx)).cast("double") / chars
    cols = [
        F.log1p(chars), F.log1p(n), chars / n, F.size(F.array_distinct(w)).cast("double") / n,
        per_char("[#$%&*]"), per_char("[@~^<>{}=_+]"), per_char("[|]"), per_char("!"), per_char("\\p{Lu}"), per_char("[0-9]"), per_char("[.?]"), per_char("[,;:]"), per_char("\n"),
        F.expr("aggregate(w, struct('' as p, 0 as c), (a, x) -> struct(x as p, a.c + if(a.p = x, 1, 0) as c), a -> a.c)").cast("double") / n,
    ]
    return F.split(F.btrim(text, F.lit(" \t\r\n\f")), "\\s+"), cols


def features(docs: DataFrame, *keep: Column) -> DataFrame:
    """``keep`` and one double column for each feature. Blank texts have null features."""
    rows = docs.select(*keep, docs["text"].alias("t"))
    w, cols = statistics(F.col("t"))
    rows = rows.withColumn("w", w)
    names = [c for c in rows.columns if c not in ("t", "w")]
    some = F.coalesce(F.col("t"), F.lit("")).rlike("\\S")
    return rows.select(*names, *(F.when(some, c).alias(f) for f, c in zip(FEATURES, cols, strict=True)))


@dataclass(frozen=True)
class Rule:
    """A conjunction of ``(feature, is_greater, threshold)``."""

    terms: tuple[tuple[str, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        ok = np.ones(len(x), bool)
        for f, greater, at in self.terms:
            v = x[:, FEATURES.index(f)]
            ok &= (v > at) if greater else (v <= at)
        return ok

    def column(self) -> Column:
        parts = [(F.col(f) > F.lit(at)) if greater else (F.col(f) <= F.lit(at)) for f, greater, at in self.terms]
        out = parts[0]
        for p in parts[1:]:
            out = out & p
        return out


@dataclass
class RuleEnsemble:
    intercept: float = 0.0
    rules: list[Rule] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for r, w in zip(self.rules, self.weights, strict=True):
            z += w * r.holds(x)
        return 1 / (1 + np.exp(-z))

    def column(self) -> Column:
        """The probability, over the feature columns; 0.0 where they are null."""
        terms = [F.when(r.column(), float(w)).otherwise(0.0) for r, w in zip(self.rules, self.weights, strict=True)]
        while len(terms) > 1:  # a balanced sum
            terms = [a + b for a, b in zip(terms[::2], terms[1::2])] + ([terms[-1]] if len(terms) % 2 else [])
        z = F.lit(self.intercept) + (terms[0] if terms else F.lit(0.0))
        return F.when(F.col(FEATURES[0]).isNull(), 0.0).otherwise(1 / (1 + F.exp(-z)))


def _tree(binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, held: np.ndarray, terms: tuple, rules: set, step: np.ndarray) -> None:
    """Grow one tree on the gradients of ``rows``; adds every path to ``rules``, and the leaf's value to ``step`` for all rows that it holds."""
    if terms:
        rules.add(Rule(terms))
    value = g[rows].sum() / (h[rows].sum() + 1)
    best = (1e-6, None, None)
    if len(terms) < DEPTH:
        base = g[rows].sum() ** 2 / (h[rows].sum() + 1)
        for f in range(binned.shape[1]):
            if not len(edges[f]):
                continue
            gs = np.cumsum(np.bincount(binned[rows, f], g[rows], len(edges[f]) + 1))
            hs = np.cumsum(np.bincount(binned[rows, f], h[rows], len(edges[f]) + 1))
            ns = np.cumsum(np.bincount(binned[rows, f], minlength=len(edges[f]) + 1))
            gl, hl, nl = gs[:-1], hs[:-1], ns[:-1]
            gain = gl**2 / (hl + 1) + (gs[-1] - gl) ** 2 / (hs[-1] - hl + 1) - base
            gain[(nl < 5) | (ns[-1] - nl < 5)] = 0
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], f, k)
    _, f, k = best
    if f is None:
        step[held] += value
        return
    left, below = binned[rows, f] <= k, binned[held, f] <= k
    for side, part, all_ in ((False, rows[left], held[below]), (True, rows[~left], held[~below])):
        _tree(binned, edges, g, h, part, all_, (*terms, (FEATURES[f], side, float(edges[f][k]))), rules, step)


def _lasso(r: np.ndarray, y: np.ndarray, l1: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient on the mean logistic loss; the intercept isn't penalised."""
    x = np.hstack([np.ones((len(r), 1)), r])
    beta = look = np.zeros(x.shape[1])
    v = np.ones(x.shape[1])
    for _ in range(20):  # the largest eigenvalue bounds the curvature
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v)
    rate, t = 4 * len(y) / float(v @ (x.T @ (x @ v))), 1.0
    for _ in range(steps):
        grad = x.T @ (1 / (1 + np.exp(-(x @ look))) - y) / len(y)
        new = look - rate * grad
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * l1, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, beta, t = new + (t - 1) / t2 * (new - beta), new, t2
    return float(beta[0]), beta[1:]


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> RuleEnsemble:
    """A rule ensemble for features ``x`` (one column for each of ``FEATURES``) and labels 0 or 1."""
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 1.0
        return RuleEnsemble(30.0 if share == 1 else -30.0)
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    edges = [e[e < x[:, f].max()] for f, e in enumerate(edges)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    z, found = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), set()
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        step = np.zeros(len(y))
        rows = np.sort(rng.choice(len(y), max(1, int(0.7 * len(y))), replace=False))
        _tree(binned, edges, y - p, p * (1 - p), rows, np.arange(len(y)), (), found, step)
        z += 0.3 * step
    rules = sorted(found, key=lambda r: (len(r.terms), r.terms))
    matrix = np.stack([r.holds(x) for r in rules], 1).astype(float)
    _, unique = np.unique(matrix, axis=1, return_index=True)  # rules that hold on the same rows: the simplest stays
    unique.sort()
    intercept, w = _lasso(matrix[:, unique], y, L1)
    keep = np.flatnonzero(w)
    return RuleEnsemble(intercept, [rules[unique[k]] for k in keep], w[keep])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> RuleEnsemble:
    """Fit on at most ``sample`` labelled documents of ``docs``."""
    known = labels.filter(labels["doc_id"].isNotNull() & labels["quality"].isin(0, 1)).groupBy(labels["doc_id"].cast("long").alias("__id"))
    known = known.agg(F.min(labels["quality"]).alias("__y"), F.max(labels["quality"]).alias("__z")).filter("__y = __z")
    known = known.orderBy(F.md5(F.col("__id").cast("string").cast("binary")), "__id").limit(sample)
    # the sample is bounded by its parameter, so it may be broadcast at every size of the input
    text = docs.select(docs["doc_id"].cast("long").alias("__id"), docs["text"].alias("text")).filter("text IS NOT NULL")
    rows = text.join(F.broadcast(known), "__id")
    found = features(rows, rows["__id"], rows["__y"]).filter(F.col(FEATURES[0]).isNotNull()).toPandas()
    found = found.drop_duplicates().sort_values(["__id", *FEATURES])
    return fit(found[FEATURES].to_numpy(float), found["__y"].to_numpy(float))


def classify(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """``doc_id, quality, keep`` for every row."""
    rows = features(docs, docs["doc_id"].alias("doc_id"))
    return rows.select("doc_id", model.column().alias("quality")).withColumn("keep", F.col("quality") >= KEEP_AT)


def keep_good(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """``docs`` without the rows that the model rejects."""
    names = docs.columns
    rows = docs.select(F.struct(*(docs[c] for c in names)).alias("__row"), docs["text"].alias("text"))
    # the counter keeps the optimizer from pushing the filter below the statistics, where every mention of one would
    # compute it again; the condition on it is always true
    scored = features(rows, rows["__row"]).select("__row", model.column().alias("__quality"), F.monotonically_increasing_id().alias("__n"))
    return scored.filter((F.col("__quality") >= KEEP_AT) & (F.col("__n") >= 0)).select("__row.*")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, train(docs, table(spark, sf_dir, "labels")))
