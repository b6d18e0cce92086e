"""BPE encoding and decoding, with tree concatenation of long texts.

A text of ``LONG`` characters or more isn't split beforehand. It is halved again and again down to ``LEAF`` characters, wherever the
cuts fall; the leaves are encoded by all tasks in parallel. Neighbours are then concatenated pairwise up the tree, ``ARITY`` leaves in a task
and such tasks in parallel, level by level. At a join, the window of pieces around the cut is split and encoded afresh:

* it begins at a piece that the cut can't have touched, and grows to the right until one of its pieces ends where one of the right side's
  does; since splitting goes on from there in the same way, both sides then agree with the window;
* a long piece across the cut (text without breaks) isn't encoded as a whole: a window of tokens around the cut is, and it grows until its first
  token is the left side's and its last token the right side's. A sequence of tokens is the encoding of its bytes when every
  adjacent pair is, so such an agreement makes the result exact.

Decoding gathers the tokens' bytes; every row's decoded text is compared with its text.

Defined cases: a null text has null tokens, the empty text no tokens; whole texts are encoded, however long;
equal rows give equal results and each stays; a null ``doc_id`` stays null; other columns are ignored, whatever their names; an empty table gives
no rows; strings of special tokens are ordinary text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate, chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, trim
from .token_counts import PATTERN, VOCABULARY, load_ranks

LONG = 16_384
LEAF = 4_096
#: leaves (or nodes of the next level) that one task joins
ARITY = 64
#: pieces and tokens on each side of a join in the first window
PIECES, WINDOW = 16, 4
#: no piece depends on characters further than this behind its end
SLACK = 8
#: characters of a piece from which on it is encoded by windows of tokens
UNBROKEN = 512
#: pieces whose tokens a worker remembers
KEPT = 100_000


@lru_cache(maxsize=4)
def encoding(vocabulary: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=load_ranks(vocabulary), special_tokens={})


@lru_cache(maxsize=4)
def token_bytes(vocabulary: str) -> pa.Array:
    ranks = load_ranks(vocabulary)
    out = [b""] * (max(ranks.values()) + 1)
    for token, k in ranks.items():
        out[k] = token
    return pa.array(out, pa.large_binary())


def decode_flat(tokens: np.ndarray, vocabulary: str) -> bytes:
    """The bytes of all tokens in a row."""
    if not len(tokens):
        return b""
    _, offsets, data = token_bytes(vocabulary).take(pa.array(tokens)).buffers()
    ends = np.frombuffer(offsets, np.int64, len(tokens) + 1)
    return data[ends[0] : ends[-1]].to_pybytes() if data else b""


def join_tokens(left: list[int], right: list[int], encode: Callable[[bytes], list[int]], raw: Callable[[list[int]], bytes]) -> list[int]:
    """The exact encoding of two encoded neighbours."""
    if not left or not right:
        return left + right
    k = WINDOW
    while True:
        a, b = max(0, len(left) - k), min(len(right), k)
        middle = encode(raw(left[a:]) + raw(right[:b]))
        if (a == 0 or middle[0] == left[a]) and (b == len(right) or middle[-1] == right[b - 1]):
            return left[:a] + middle + right[b:]
        k *= 2


def halves(text: str, leaf: int = LEAF) -> list[str]:
    """Leaves of the tree of halves, from left to right."""
    if len(text) <= leaf:
        return [text]
    depth = (-(-len(text) // leaf) - 1).bit_length()
    at = [len(text) * k >> depth for k in range((1 << depth) + 1)]
    return [text[a:b] for a, b in zip(at, at[1:])]


class Node(NamedTuple):
    """A stretch of text: its tokens, and how many of them each piece has."""

    tokens: np.ndarray
    counts: np.ndarray


class Joiner:
    """Encodes leaves and joins neighbours, for one vocabulary and pattern."""

    def __init__(self, vocabulary: str, pattern: str):
        self.vocabulary = vocabulary
        self.split = regex.compile(pattern).findall
        enc = encoding(vocabulary, pattern)
        self.one, self.raw, self.kept = enc._encode_single_piece, enc.decode_bytes, {}

    def piece(self, text: str) -> list[int]:
        tokens = self.kept.get(text)
        if tokens is None:
            tokens = self.one(text.encode())
            if len(text) < 40:
                if len(self.kept) >= KEPT:
                    self.kept.clear()
                self.kept[text] = tokens
        return tokens

    @staticmethod
    def node(tokens: list[list[int]]) -> Node:
        return Node(np.fromiter(chain.from_iterable(tokens), np.int32), np.fromiter(map(len, tokens), np.int32, len(tokens)))

    def leaf(self, text: str) -> Node:
        return self.node([self.piece(p) for p in self.split(text)])

    def pieces(self, node: Node, begin: int, end: int) -> tuple[list[str], list[list[int]]]:
        """Texts and tokens of some pieces of a node."""
        ends = np.cumsum(node.counts[begin:end])
        first = int(node.counts[:begin].sum())
        tokens = [x.tolist() for x in np.split(node.tokens[first : first + (int(ends[-1]) if len(ends) else 0)], ends[:-1])] if end > begin else []
        return [decode_flat(np.array(t, np.int32), self.vocabulary).decode() for t in tokens], tokens

    def join(self, left: Node, right: Node) -> Node:
        """The exact encoding of two neighbours."""
        if not len(left.counts) or not len(right.counts):
            return left if len(left.counts) else right
        nl, nr, k = len(left.counts), len(right.counts), PIECES
        while True:  # pieces that end SLACK characters before the cut stay as they are
            a = max(0, nl - k)
            lp, lt = self.pieces(left, a, nl)
            if a == 0 or sum(map(len, lp)) >= SLACK:
                break
            k *= 2
        cut, k = sum(map(len, lp)), PIECES
        while True:
            b = min(nr, k)
            rp, rt = self.pieces(right, 0, b)
            window = "".join(lp) + "".join(rp)
            new = self.split(window)
            ends = {e: j + 1 for j, e in enumerate(accumulate(map(len, new)))}
            limit = len(window) if b == nr else len(window) - SLACK
            # where a piece of the right side begins, or its text ends
            agreed = next(((e, j) for j, e in enumerate(accumulate(map(len, rp), initial=cut)) if e in ends and e <= limit), None)
            if agreed:
                break
            k *= 2
        end, kept = agreed
        middle, at = [], 0
        for p in new[: ends[end]]:
            middle.append(self.across(p, at, cut, lp, lt, rp, rt) if at < cut < at + len(p) and len(p) >= UNBROKEN else self.piece(p))
            at += len(p)
        mid = self.node(middle)
        before, after = int(left.counts[:a].sum()), int(right.counts[:kept].sum())
        return Node(np.concatenate([left.tokens[:before], mid.tokens, right.tokens[after:]]), np.concatenate([left.counts[:a], mid.counts, right.counts[kept:]]))

    def across(self, p: str, at: int, cut: int, lp: list[str], lt: list[list[int]], rp: list[str], rt: list[list[int]]) -> list[int]:
        """A long piece across the cut, from the encodings of its two parts."""
        parts = [(at, p[: cut - at], lp, lt, 0), (cut, p[cut - at :], rp, rt, cut)]
        out: list[int] = []
        for begin, text, texts, tokens, base in parts:
            starts = [base, *(base + e for e in accumulate(map(len, texts)))]
            if begin in starts and begin + len(text) in starts:
                found = tokens[starts.index(begin) : starts.index(begin + len(text))]
            else:
                found = [self.one(text.encode())]
            for t in found:
                out = join_tokens(out, t, self.one, self.raw)
        return out

    def tree(self, nodes: list[Node]) -> Node:
        while len(nodes) > 1:
            pairs = [self.join(a, b) for a, b in zip(nodes[::2], nodes[1::2])]
            nodes = pairs + nodes[len(pairs) * 2 :]
        return nodes[0]


@lru_cache(maxsize=4)
def joiner(vocabulary: str, pattern: str) -> Joiner:
    return Joiner(vocabulary, pattern)


def encode_text(text: str, vocabulary: str = VOCABULARY, pattern: str = PATTERN, leaf: int = LEAF) -> list[int]:
    """One text by the tree, in this process."""
    j = joiner(vocabulary, pattern)
    return j.tree([j.leaf(x) for x in halves(text, leaf)]).tokens.tolist()


OUT = "doc_id long, tokens array<int>, n_tokens int, round_trip boolean"


def _rows(ids: pa.Array, tokens: list[np.ndarray | None], same: list[bool]) -> pa.RecordBatch:
    count = np.array([0 if t is None else len(t) for t in tokens], np.int64)
    offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, np.int32), *(t for t in tokens if t is not None)]).astype(np.int32)
    gone = pa.array([t is None for t in tokens], pa.bool_())
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=gone)
    return pa.RecordBatch.from_arrays([ids, lists, pa.array(count.astype(np.int32)), pa.array(same, pa.bool_())], ["doc_id", "tokens", "n_tokens", "round_trip"])


def _encode(vocabulary: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary, pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                tokens = [None if t is None else enc.encode_to_numpy(t, disallowed_special=()) for t in texts]
                same = [t is None or decode_flat(k, vocabulary) == t.encode() for t, k in zip(texts, tokens, strict=True)]
                yield _rows(part.column("doc_id"), tokens, same)
        trim()

    return run


LEAVES = "doc_id long, sha string, leaves int, leaf int, part string"
NODES = "doc_id long, sha string, copies long, leaves int, node int, tokens array<int>, counts array<int>"


def _leaves(leaf: int):
    """The leaves of each text's tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in range(batch.num_rows):
                row = batch.slice(one, 1)
                parts = halves(row.column("text")[0].as_py(), leaf)
                n = len(parts)
                same = [pa.array([row.column(c)[0].as_py()] * n, t) for c, t in (("doc_id", pa.int64()), ("sha", pa.string()))]
                yield pa.RecordBatch.from_arrays([*same, pa.array([n] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(parts, pa.string())], ["doc_id", "sha", "leaves", "leaf", "part"])
        trim()

    return run


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *parts]).astype(np.int32)))


def _encode_leaves(vocabulary: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        j = joiner(vocabulary, pattern)
        for batch in batches:
            for part in slices(batch, "part"):
                nodes = [j.leaf(x) for x in part.column("part").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "sha", "copies", "leaves", "leaf")), _lists([n.tokens for n in nodes]), _lists([n.counts for n in nodes])], ["doc_id", "sha", "copies", "leaves", "node", "tokens", "counts"])
        j.kept.clear()
        trim()

    return run


def _join(vocabulary: str, pattern: str, last: bool):
    """``ARITY`` neighbours to one node; of the ``last`` level a result row with its number of copies."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("node")
        numbers = lambda c: [x.values.to_numpy() for x in rows.column(c)]
        node = joiner(vocabulary, pattern).tree([Node(t, c) for t, c in zip(numbers("tokens"), numbers("counts"), strict=True)])
        one = rows.slice(0, 1)
        if last:
            same = hashlib.sha256(decode_flat(node.tokens, vocabulary)).hexdigest() == one.column("sha")[0].as_py()
            done = _rows(one.column("doc_id").combine_chunks(), [node.tokens], [same])
            return pa.table([*done.columns, one.column("copies")], [*done.schema.names, "copies"])
        at = pa.array([one.column("node")[0].as_py() // ARITY], pa.int32())
        return pa.table([*(one.column(c) for c in ("doc_id", "sha", "copies", "leaves")), at, _lists([node.tokens]), _lists([node.counts])], ["doc_id", "sha", "copies", "leaves", "node", "tokens", "counts"])

    return run


def _copies(done: DataFrame) -> DataFrame:
    """Each row as often as its ``copies``, by two steps so that no array is long."""
    step = done.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(4096).cast("long"))))
    step = step.withColumn("one", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + 4095, F.col("copies") - 1))))
    return step.drop("copies", "from", "one")


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, long: int = LONG, leaf: int = LEAF) -> DataFrame:
    """``doc_id, tokens, n_tokens, round_trip`` for every row; ``round_trip``: decoding gives the text back."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    unsplit = F.coalesce(F.length("text") >= long, F.lit(False))
    short = rows.filter(~unsplit).mapInArrow(_encode(vocabulary, pattern), OUT)
    longest = rows.agg(F.max(F.length("text"))).first()[0] or 0
    if longest < long:
        return short
    held = rows.filter(unsplit).select("doc_id", F.sha2(F.encode("text", "utf-8"), 256).alias("sha"), "text")
    # rows that repeat both id and text are encoded once; the exchange that finds them also spreads the leaves over all tasks
    leaves = held.mapInArrow(_leaves(leaf), LEAVES).groupBy("doc_id", "sha", "leaves", "leaf").agg(F.first("part").alias("part"), F.count("*").alias("copies"))
    nodes, left = leaves.mapInArrow(_encode_leaves(vocabulary, pattern), NODES), 2 * longest // leaf + 2
    while True:
        left = -(-left // ARITY)
        last = left <= 1  # it gives results itself: with a second Python operator behind it every task would keep two workers
        nodes = nodes.groupBy("doc_id", "sha", F.expr(f"node div {ARITY}")).applyInArrow(_join(vocabulary, pattern, last), f"{OUT}, copies long" if last else NODES)
        if last:
            return short.unionByName(_copies(nodes))


def decode(rows: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, text`` of rows with ``doc_id, tokens``. Null tokens give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else decode_flat(np.array(t, np.int32), vocabulary).decode("utf-8", "replace") for t in batch.column("tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(rows["doc_id"].cast("long").alias("doc_id"), rows["tokens"].alias("tokens")).mapInArrow(run, "doc_id long, text string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
