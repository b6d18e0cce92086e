"""Token counts by rank-synchronous array merging.

Pre-tokens of a batch are held as one ragged numpy array of symbol ids. In each round every sequence
finds the lowest rank among its adjacent pairs and all its pairs of that rank merge at once, leftmost
first; sequences without a mergeable pair leave. What counts are the symbols that survive. Each distinct
pre-token of a batch is merged once.

Defined cases: a null or empty text has 0 tokens; text is never cut, however long; equal rows give
equal counts; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import runs, slices, table

#: vocabulary of ranked byte sequences; a parameter of every function below
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEPT = 600_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairTable:
    """Ranks of adjacent symbol pairs, as an open-addressing table that is probed for whole arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, rank = [], [], []
        for token, r in ranks.items():
            # every way to write a token as two tokens: the pair merges at the rank of the whole
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(r)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        keys = (np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64)
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.mask = np.uint64((1 << self.bits) - 1)
        self.keys = np.full(1 << self.bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.ranks = np.full(1 << self.bits, -1, np.int64)
        self.probes = 0
        todo, rank_of = keys, np.array(rank, np.int64)
        slot = self._slot(todo)
        while len(todo):
            self.probes += 1
            free = self.keys[slot] == np.uint64(0xFFFFFFFFFFFFFFFF)
            self.keys[slot[free]] = todo[free]  # of several keys for a slot the last stays
            won = self.keys[slot] == todo
            self.ranks[slot[won]] = rank_of[won]
            todo, rank_of, slot = todo[~won], rank_of[~won], (slot[~won] + np.uint64(1)) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def look(self, left: np.ndarray, right: np.ndarray, none: int) -> np.ndarray:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot, out = self._slot(keys), np.full(len(keys), none, np.int64)
        at = np.arange(len(keys))
        for _ in range(self.probes):
            found = self.keys[slot]
            hit = found == keys
            out[at[hit]] = self.ranks[slot[hit]]
            go = ~hit & (found != np.uint64(0xFFFFFFFFFFFFFFFF))
            if not go.any():
                break
            keys, at, slot = keys[go], at[go], (slot[go] + np.uint64(1)) & self.mask
        return out


@lru_cache(maxsize=4)
def pair_table(path: str) -> PairTable:
    return PairTable(load_ranks(path))


NONE = 1 << 40


def merge_all(pairs: PairTable, pretokens: list[bytes]) -> np.ndarray:
    """Number of symbols that survive in each pre-token."""
    lengths = np.array([len(p) for p in pretokens], np.int64)
    result = lengths.copy()
    symbols = pairs.byte_ids[np.frombuffer(b"".join(pretokens), np.uint8)]
    owner = np.repeat(np.arange(len(pretokens)), lengths)
    rank = None
    while len(symbols) > 1:
        if rank is None:
            rank = pairs.look(symbols[:-1], symbols[1:], NONE)
            rank[owner[:-1] != owner[1:]] = NONE
            rank = np.append(rank, NONE)  # of the pair that begins at each symbol
        starts, sizes = runs(owner)
        lowest = np.minimum.reduceat(rank, starts)
        open_ = lowest < NONE
        if not open_.all():
            keep = np.repeat(open_, sizes)
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            lowest, sizes = lowest[open_], sizes[open_]
            if not len(symbols):
                break
        hit = rank == np.repeat(lowest, sizes)
        # in a run of overlapping pairs (aaa) every second one merges, from the left
        at = np.flatnonzero(hit)
        begin, count = runs(at - np.arange(len(at)))
        place = np.arange(len(at)) - np.repeat(begin, count)
        at = at[place % 2 == 0]
        symbols[at] = rank[at]
        stay = np.ones(len(symbols), bool)
        stay[at + 1] = False
        np.subtract.at(result, owner[at], 1)
        merged = np.zeros(len(symbols), bool)
        merged[at] = True
        symbols, owner, rank, merged = symbols[stay], owner[stay], rank[stay], merged[stay]
        # only pairs beside a merged symbol have new ranks
        merged[:-1] |= merged[1:]
        new = np.flatnonzero(merged[:-1])
        value = pairs.look(symbols[new], symbols[new + 1], NONE)
        value[owner[new] != owner[new + 1]] = NONE
        rank[new] = value
        rank[-1] = NONE
    return result


def counts_of(texts: list[str | None], pairs: PairTable, split, kept: dict[str, int]) -> np.ndarray:
    """Token counts of texts; ``kept`` holds counts of pre-tokens seen before."""
    found = [split(t) if t else [] for t in texts]
    fresh = {p for ps in found for p in ps}.difference(kept)
    if fresh:
        if len(kept) > KEPT:
            kept.clear()
            fresh = {p for ps in found for p in ps}
        fresh = list(fresh)
        kept.update(zip(fresh, merge_all(pairs, [p.encode() for p in fresh]).tolist(), strict=True))
    get = kept.__getitem__
    return np.array([sum(map(get, ps)) for ps in found], np.int64)


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``doc_id, n_tokens`` for every row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, split, kept = pair_table(vocabulary), regex.compile(pattern).findall, {}
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                n = counts_of(part.column("text").to_pylist(), pairs, split, kept)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n)], ["doc_id", "n_tokens"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_tokens long")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
