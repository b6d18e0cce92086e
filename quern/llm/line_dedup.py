"""Line deduplication with a sharded minimal perfect hash.

A line is known by 96 bits: a 64-bit hash and a fingerprint of 32 bits from another hash. Each shard of hashes builds a minimal perfect hash
(levels of bit arrays: a key rests at the first level where it has a bit to itself; its slot is the rank of that bit), which indexes compact
arrays: the fingerprint, the count, and the place of the first occurrence. The documents then probe the arrays with their
hashes, shard by shard; no line is joined with another line. The index is a table of one row for each shard and serves any
documents, also others than those it was built from: a fingerprint that differs is a line never seen. Of lines with one hash and other
fingerprints the first goes by the hash, and the rest by a second key made of both.

A line is dropped where its count is ``least`` or more and it isn't the first occurrence, by ``doc_id`` and line number.
Lines are compared without surrounding white space.

Defined cases: blank lines are never dropped; a null text stays null with 0 lines; rows with a null ``doc_id`` are
neither counted nor changed; rows that repeat both id and text are one document, and all keep the same lines; rows
with one id and other texts are ordered by a hash of the text; whole texts and lines count, however long; other columns are left out of the
result, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, bits_for, cut, hash_strings, mix, pack, runs, slices, table, text_bytes, unpack

#: bytes of text for each shard of line hashes
SHARD_BYTES = 64 << 20
GAMMA = 1.6
LEVELS = 40
#: line numbers to drop are broadcast up to this many bytes
BROADCAST_BYTES = 32 << 20


class PerfectHash:
    """A minimal perfect hash over distinct 64-bit keys: bit arrays by level; keys left after the last are listed."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self.ranks, base = [], 0
        for bits in levels:
            self.ranks.append(base + np.cumsum(bits) - 1)
            base += int(bits.sum())
        self.size = base + len(rest)

    @staticmethod
    def _place(keys: np.ndarray, level: int, n: int) -> np.ndarray:
        return (mix(keys + U64(0x9E3779B97F4A7C15 * (level + 1) & 0xFFFFFFFFFFFFFFFF)) % U64(n)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys) and len(levels) < LEVELS:
            n = -(-int(GAMMA * len(keys) + 8) // 8) * 8
            at = cls._place(keys, len(levels), n)
            alone = np.bincount(at, minlength=n) == 1
            levels.append(alone)
            keys = keys[~alone[at]]
        return cls(levels, np.sort(keys))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """A slot for each key; for a key that isn't in the set any slot, or -1."""
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            at = self._place(keys[todo], k, len(bits))
            hit = bits[at]
            out[todo[hit]] = self.ranks[k][at[hit]]
            todo = todo[~hit]
        if len(self.rest) and len(todo):
            at = np.minimum(np.searchsorted(self.rest, keys[todo]), len(self.rest) - 1)
            hit = self.rest[at] == keys[todo]
            out[todo[hit]] = self.size - len(self.rest) + at[hit]
        return out

    def dump(self) -> bytes:
        return pack(np.array([len(b) for b in self.levels], np.int64), np.packbits(np.concatenate([np.zeros(0, bool), *self.levels])), self.rest)

    @classmethod
    def load(cls, blob: bytes) -> PerfectHash:
        sizes, packed, rest = unpack(blob, "i8", "u1", "u8")
        bits = np.unpackbits(packed)[: int(sizes.sum())].astype(bool)
        return cls(np.split(bits, np.cumsum(sizes)[:-1]) if len(sizes) else [], rest)


def second(h: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """The key of a line whose hash another line has."""
    return mix(h + mix(mark.astype(U64) + U64(0xF1A9)))


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, text, k``: ``k`` tells rows of one id with other texts apart."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return rows.withColumn("k", F.xxhash64("text"))


def line_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, line number, hash and fingerprint of every line that isn't blank."""
    lists = pc.split_pattern(pc.fill_null(texts, "").cast(pa.large_string()), "\n")
    offsets = np.asarray(lists.offsets).astype(np.int64)
    flat = pc.utf8_trim_whitespace(lists.values.slice(offsets[0], offsets[-1] - offsets[0]))
    offsets = offsets - offsets[0]
    coded = flat.dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    codes = np.asarray(coded.indices)
    count = np.diff(offsets)
    row = np.repeat(np.arange(len(count)), count)
    number = np.arange(len(codes)) - np.repeat(offsets[:-1], count)
    keep = codes != (distinct.index("") if "" in distinct else -1)
    codes = codes[keep]
    other = pd.util.hash_array(np.asarray(distinct, dtype=object), hash_key="fedcba9876543210", categorize=False) if distinct else np.zeros(0, U64)
    return row[keep], number[keep], hash_strings(distinct)[codes], (other >> U64(32)).astype(np.uint32)[codes]


PROBES = "shard int, payload binary"


def probes(docs: DataFrame, bits: int) -> DataFrame:
    """Line hashes with their places, by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                row, number, h, mark = line_hashes(part.column("text"))
                shard = (mix(h) >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
                order = np.argsort(shard, kind="stable")
                shard, row, number, h, mark = shard[order], row[order], number[order], h[order], mark[order]
                ids, ks = np.asarray(part.column("doc_id")), np.asarray(part.column("k"))
                out, blobs = [], []
                for s, c in zip(*runs(shard)):
                    r = row[s : s + c]
                    out.append(int(shard[s]))
                    blobs.append(pack(h[s : s + c], mark[s : s + c], ids[r], ks[r], number[s : s + c].astype(np.uint32)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.int32()), pa.array(blobs, pa.binary())], ["shard", "payload"])

    rows = keyed(docs).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(run, PROBES)


def _occurrences(rows: pa.Table) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate(x) for x in zip(*(unpack(p.as_py(), "u8", "u4", "i8", "i8", "u4") for p in rows.column("payload"))))


INDEX = "shard int, hash binary, arrays binary"


def build_index(lines: DataFrame) -> DataFrame:
    """One row for each shard: the perfect hash, and its fingerprint, count and first-place arrays."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        h, mark, ids, ks, number = _occurrences(rows)
        order = np.lexsort((number, ks, ids, mark, h))
        h, mark, ids, ks, number = h[order], mark[order], ids[order], ks[order], number[order]
        like = np.zeros(len(h), bool)
        like[1:] = (h[1:] == h[:-1]) & (mark[1:] == mark[:-1])
        same = like.copy()  # a repeated row isn't another occurrence
        same[1:] &= (ids[1:] == ids[:-1]) & (ks[1:] == ks[:-1]) & (number[1:] == number[:-1])
        h, mark, ids, ks, number, like = h[~same], mark[~same], ids[~same], ks[~same], number[~same], like[~same]
        starts = np.flatnonzero(~like)
        count = np.diff(np.append(starts, len(h)))
        keys, mark = h[starts].copy(), mark[starts]
        again = np.flatnonzero(keys[1:] == keys[:-1]) + 1
        keys[again] = second(keys[again], mark[again])
        perfect = PerfectHash.build(keys)
        slot = perfect.slots(keys)
        put = lambda x, kind: (lambda a: (a.__setitem__(slot, x), a)[1])(np.zeros(len(slot), kind))
        arrays = pack(put(mark, np.uint32), put(count, np.int64), put(ids[starts], np.int64), put(ks[starts], np.int64), put(number[starts], np.uint32))
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([perfect.dump()], pa.binary()), pa.array([arrays], pa.binary())], ["shard", "hash", "arrays"])

    return lines.groupBy("shard").applyInArrow(run, INDEX)


def probe(lines: DataFrame, index: DataFrame, least: int = 2) -> DataFrame:
    """``doc_id, k, line``: every line of ``lines`` that the index calls a repeat."""
    names = ["doc_id", "k", "line"]

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table, own: pa.Table) -> pa.Table:
        if not len(rows) or not len(own):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.int32())], names)
        h, mark, ids, ks, number = _occurrences(rows)
        perfect = PerfectHash.load(own.column("hash")[0].as_py())
        marks, count, first_id, first_k, first_line = unpack(own.column("arrays")[0].as_py(), "u4", "i8", "i8", "i8", "u4")

        def look(keys: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            slot = perfect.slots(keys)
            return np.maximum(slot, 0), (slot >= 0) & (marks[np.maximum(slot, 0)] == mark)

        slot, known = look(h, mark)
        rest = np.flatnonzero(~known)
        slot[rest], known[rest] = look(second(h[rest], mark[rest]), mark[rest])
        first = (first_id[slot] == ids) & (first_k[slot] == ks) & (first_line[slot] == number)
        drop = known & (count[slot] >= least) & ~first
        return pa.table([pa.array(ids[drop]), pa.array(ks[drop]), pa.array(number[drop].astype(np.int32))], names)

    return lines.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(run, "doc_id long, k long, line int")


def dedup_lines(docs: DataFrame, least: int = 2) -> DataFrame:
    """``doc_id, text, n_lines, n_dropped`` for every row."""
    bits = bits_for(text_bytes(docs), SHARD_BYTES)
    lines = cut(probes(docs, bits))
    index = cut(build_index(lines))
    drops = probe(lines, index, least).groupBy("doc_id", "k").agg(F.sort_array(F.collect_set("line")).alias("drops"))
    drops = cut(drops)
    size = drops.agg(F.sum(F.size("drops") * 4 + 32)).first()[0] or 0
    rows = keyed(docs).join(F.broadcast(drops) if size <= BROADCAST_BYTES else drops, ["doc_id", "k"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                text, drop = part.column("text"), part.column("drops")
                lists = pc.split_pattern(text.cast(pa.large_string()), "\n")
                count = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
                gone = np.asarray(pc.fill_null(pc.list_value_length(drop), 0)).astype(np.int64)
                offsets = np.concatenate([[0], np.cumsum(count)])
                keep = np.ones(offsets[-1], bool)
                keep[np.repeat(offsets[:-1], gone) + np.asarray(pc.list_flatten(drop)).astype(np.int64)] = False
                left = np.concatenate([[0], np.cumsum(keep)])[offsets]
                bare = pa.ListArray.from_arrays(pa.array(left.astype(np.int32)), pc.list_flatten(lists).filter(pa.array(keep)), mask=pc.is_null(text))
                out = pc.if_else(pa.array(gone > 0), pc.binary_join(bare, pa.scalar("\n", pa.large_string())), text.cast(pa.large_string())).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), out, pa.array(count.astype(np.int32)), pa.array(gone.astype(np.int32))], ["doc_id", "text", "n_lines", "n_dropped"])

    return rows.select("doc_id", "text", "drops").mapInArrow(run, "doc_id long, text string, n_lines int, n_dropped int")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))


SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n
  FROM documents),
r AS (
  SELECT *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS bare FROM l),
k AS (
  SELECT doc_id, line, n, bare <> '' AND row_number() OVER (PARTITION BY bare ORDER BY doc_id, n) > 1 AS gone FROM r)
SELECT d.doc_id,
       CASE WHEN d.text IS NOT NULL THEN coalesce(string_agg(k.line, chr(10) ORDER BY k.n) FILTER (WHERE NOT k.gone), '') END AS text,
       CAST(count(k.n) AS INTEGER) AS n_lines, CAST(count(k.n) FILTER (WHERE k.gone) AS INTEGER) AS n_dropped
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id GROUP BY d.doc_id, d.text
"""
