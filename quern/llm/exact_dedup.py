"""Exact deduplication with a cuckoo-filter index of live digests.

Digests (64 leading bits of SHA-256 of the text) are hash-partitioned into shards. Each shard owns a cuckoo filter: two candidate
buckets of four 16-bit fingerprints for a key, and in a second array of the same shape the stored keys, slot by slot. A
filter miss proves a digest new. A hit is only a suspicion: it is verified against the keys stored in its two buckets, and
suspected documents then against their whole contents. Insertion that overflows (too many evictions, or a load over
``MAX_LOAD``) doubles the filter and refills it from the stored keys. Deleting a live digest frees its slot, so that the next copy
counts as new. All three work on whole arrays of keys.

Between runs the index is a table ``shard, buckets, slots, keys``: ``insert_digests`` and ``delete_digests`` map a table to
the next one, all shards at once; ``known`` tells which documents of a new delivery are live already. A single run over one table
has nothing to delete: its filters see every digest once, and what they meet again is suspected.

Digests of an input batch are merged before they are shuffled, so a text that is copied any number of times sends a shard one
entry for each batch. Contents are read again for suspected copies alone; equal contents merge before their shuffle.

Defined cases: a null text or a null ``doc_id`` is never a copy and never a representative; the empty text is an
ordinary text; whole texts count, however long; of equal texts the smallest ``doc_id`` is live; rows that repeat a ``doc_id`` with the
same text are one document for ``duplicates`` and leave one row in ``deduplicate``; of a ``doc_id`` with several texts each text is
a document of its own, and only the copies among them go; other columns are carried along whatever their names; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, cut, drop_rows, mix, pack, pieces, runs, small, table, text_key, unpack

SLOTS = 4
MAX_KICKS = 200
MAX_LOAD = 0.94
#: documents for each shard of digests
SHARD_ROWS = 400_000
#: digests that are merged or inserted in one step
AT_ONCE = 200_000


class CuckooFilter:
    """A filter over 64-bit digests with its keys stored bucket by bucket; ``resizes`` counts the doublings."""

    def __init__(self, keys: int = 64, slots: np.ndarray | None = None, stored: np.ndarray | None = None):
        self.resizes = 0
        if slots is None:
            self._clear(1 << max(2, int(keys / SLOTS / MAX_LOAD).bit_length()))
        else:
            self.slots, self.stored = slots.reshape(-1, SLOTS).copy(), stored.reshape(-1, SLOTS).copy()

    def _clear(self, buckets: int) -> None:
        self.slots = np.zeros((buckets, SLOTS), np.uint16)
        self.stored = np.zeros((buckets, SLOTS), U64)

    @property
    def buckets(self) -> int:
        return len(self.slots)

    def keys(self) -> np.ndarray:
        return self.stored[self.slots > 0]

    def __len__(self) -> int:
        return int(np.count_nonzero(self.slots))

    @staticmethod
    def _mark(keys: np.ndarray) -> np.ndarray:
        return np.maximum(keys & U64(0xFFFF), U64(1)).astype(np.uint16)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(mark.astype(U64)) & U64(self.buckets - 1)).astype(np.int64)

    def _spots(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark = self._mark(keys)
        one = ((keys >> U64(16)) & U64(self.buckets - 1)).astype(np.int64)
        return mark, one, self._other(one, mark)

    def suspects(self, keys: np.ndarray) -> np.ndarray:
        """Whether a fingerprint of each key stands in one of its two buckets."""
        mark, one, two = self._spots(keys)
        return ((self.slots[one] == mark[:, None]) | (self.slots[two] == mark[:, None])).any(1)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each key whether it is live, its bucket and its slot: hits of the filter, verified against their buckets' keys."""
        mark, one, two = self._spots(keys)
        live, bucket, slot = np.zeros(len(keys), bool), one.copy(), np.zeros(len(keys), np.int64)
        hit = np.flatnonzero((self.slots[one] == mark[:, None]).any(1) | (self.slots[two] == mark[:, None]).any(1))
        for at in (one, two):
            todo = hit[~live[hit]]
            same = (self.slots[at[todo]] == mark[todo, None]) & (self.stored[at[todo]] == keys[todo, None])
            found = same.any(1)
            live[todo[found]], bucket[todo[found]], slot[todo[found]] = True, at[todo[found]], same[found].argmax(1)
        return live, bucket, slot

    def contains(self, keys: np.ndarray) -> np.ndarray:
        return self._find(keys)[0]

    def _place(self, keys: np.ndarray) -> bool:
        """Put keys that aren't live into free slots, evicting others where both buckets are full. False on overflow."""
        mark, one, two = self._spots(keys)
        at, other, kicks, round_ = one, two, np.zeros(len(keys), np.int64), 0
        while len(keys):
            free = self.slots[at] == 0
            some = free.any(1)
            turn = ~some & (self.slots[other] == 0).any(1)
            at, other = np.where(turn, other, at), np.where(turn, at, other)
            free = self.slots[at] == 0
            some = free.any(1)
            # of the keys that want a bucket one goes in at a time, into a free slot or in place of another key
            _, first = np.unique(at, return_index=True)
            put = first[some[first]]
            slot = free[put].argmax(1)
            self.slots[at[put], slot], self.stored[at[put], slot] = mark[put], keys[put]
            kick = first[~some[first]]
            slot = (mark[kick].astype(np.int64) + round_) % SLOTS
            out_mark, out_key = self.slots[at[kick], slot].copy(), self.stored[at[kick], slot].copy()
            self.slots[at[kick], slot], self.stored[at[kick], slot] = mark[kick], keys[kick]
            mark[kick], keys[kick], kicks[kick] = out_mark, out_key, kicks[kick] + 1
            home = self._other(at[kick], out_mark)
            other = other.copy()
            at[kick], other[kick] = home, at[kick]
            stay = np.ones(len(keys), bool)
            stay[put] = False
            keys, mark, at, other, kicks = keys[stay], mark[stay], at[stay], other[stay], kicks[stay]
            round_ += 1
            if len(kicks) and kicks.max() > MAX_KICKS:
                self._homeless = keys
                return False
        return True

    def insert(self, keys: np.ndarray) -> np.ndarray:
        """Make keys live; False for those that are live already and for repeats. A filter that overflows doubles, and is refilled
        from the stored keys."""
        new = np.zeros(len(keys), bool)
        _, first = np.unique(keys, return_index=True)
        new[first[~self.contains(keys[first])]] = True
        fresh = keys[new]
        self._homeless = fresh[:0]
        if len(self) + len(fresh) <= MAX_LOAD * SLOTS * self.buckets and self._place(fresh.copy()):
            return new
        every = np.unique(np.concatenate([self.keys(), fresh, self._homeless]))
        buckets = self.buckets
        while True:
            buckets *= 2
            self.resizes += 1
            self._clear(buckets)
            if len(every) <= MAX_LOAD * SLOTS * buckets and self._place(every.copy()):
                return new

    def delete(self, keys: np.ndarray) -> np.ndarray:
        """Free the slots of live keys; False for keys that aren't live."""
        gone = np.zeros(len(keys), bool)
        _, first = np.unique(keys, return_index=True)
        live, bucket, slot = self._find(keys[first])
        self.slots[bucket[live], slot[live]] = 0
        gone[first[live]] = True
        return gone

    def row(self, shard: int) -> dict:
        return {"shard": shard, "buckets": self.buckets, "slots": self.slots.tobytes(), "keys": self.stored.tobytes()}

    @staticmethod
    def of(row: dict) -> CuckooFilter:
        return CuckooFilter(slots=np.frombuffer(row["slots"], np.uint16), stored=np.frombuffer(row["keys"], U64))


INDEX = "shard int, buckets long, slots binary, keys binary"


def digest_of(text: Column) -> Column:
    hex_ = F.substring(F.sha2(F.encode(text, "utf-8"), 256), 1, 16)
    high = F.conv(F.substring(hex_, 1, 8), 16, 10).cast("long")
    low = F.conv(F.substring(hex_, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def whole(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` of the documents that have both."""
    return docs.filter(docs["text"].isNotNull() & docs["doc_id"].isNotNull()).select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))


def digests(docs: DataFrame, shards: int) -> DataFrame:
    """``doc_id, digest, shard`` of the documents that have both an id and a text."""
    rows = whole(docs).select("doc_id", digest_of(F.col("text")).alias("digest"))
    return rows.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"))


def empty_index(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], INDEX)


def _filter_of(old: pa.Table, keys: int) -> CuckooFilter:
    return CuckooFilter.of(old.to_pylist()[0]) if len(old) else CuckooFilter(keys)


def _apply(index: DataFrame, changes: DataFrame, act) -> DataFrame:
    def shard(key, old: pa.Table, new: pa.Table) -> pa.Table:
        keys = np.asarray(new.column("digest")).view(U64)
        own = _filter_of(old, len(keys))
        act(own, keys)
        return pa.Table.from_pylist([own.row(key[0].as_py())], pa.schema([("shard", pa.int32()), ("buckets", pa.int64()), ("slots", pa.binary()), ("keys", pa.binary())]))

    changes = changes.select("shard", "digest").distinct()
    return index.groupBy("shard").cogroup(changes.groupBy("shard")).applyInArrow(shard, INDEX)


def insert_digests(index: DataFrame, new: DataFrame) -> DataFrame:
    """The index with the digests of ``new`` (``shard, digest``) live."""
    return _apply(index, new, CuckooFilter.insert)


def delete_digests(index: DataFrame, gone: DataFrame) -> DataFrame:
    """The index without the digests of ``gone``; digests that aren't live are passed over."""
    return _apply(index, gone, CuckooFilter.delete)


def known(index: DataFrame, new: DataFrame) -> DataFrame:
    """Of ``new`` (``shard, digest``) the distinct digests that are live in the index."""

    def shard(key, old: pa.Table, rows: pa.Table) -> pa.Table:
        keys = np.asarray(rows.column("digest")).view(U64)
        return pa.table([pa.array(keys[_filter_of(old, 0).contains(keys)].view(np.int64))], ["digest"])

    return index.groupBy("shard").cogroup(new.select("shard", "digest").distinct().groupBy("shard")).applyInArrow(shard, "digest long")


def suspected(rows: DataFrame) -> DataFrame:
    """The digests that a shard's filter meets more than once: ``digest``, one row each."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            keys, first, count = np.unique(np.concatenate(held_k), return_index=True, return_counts=True)
            shards = np.concatenate(held_s)[first]
            order = np.argsort(shards, kind="stable")
            keys, shards, twice = keys[order], shards[order], (count[order] > 1).astype(np.uint8)
            out, payloads = [], []
            for s, c in zip(*runs(shards)):
                out.append(int(shards[s]))
                payloads.append(pack(keys[s : s + c], twice[s : s + c]))
            held_k.clear(), held_s.clear()
            return pa.RecordBatch.from_arrays([pa.array(out, pa.int32()), pa.array(payloads, pa.binary())], ["shard", "payload"])

        held_k, held_s = [], []
        for batch in batches:
            held_k.append(np.asarray(batch.column("digest")).view(U64)), held_s.append(np.asarray(batch.column("shard")))
            if sum(map(len, held_k)) >= AT_ONCE:
                yield flush()
        if held_k:
            yield flush()

    def shard(rows: pa.Table) -> pa.Table:
        keys, twice = (np.concatenate(x) for x in zip(*(unpack(p.as_py(), "u8", "u1") for p in rows.column("payload"))))
        own, again = CuckooFilter(min(len(keys), AT_ONCE)), []
        for s in range(0, len(keys), AT_ONCE):
            some = keys[s : s + AT_ONCE]
            again.append(some[~own.insert(some) | (twice[s : s + AT_ONCE] > 0)])
        return pa.table([pa.array(np.unique(np.concatenate(again)).view(np.int64))], ["digest"])

    merged = rows.select("shard", "digest").mapInArrow(merge, "shard int, payload binary")
    return merged.groupBy("shard").applyInArrow(shard, "digest long")


def copies(docs: DataFrame) -> DataFrame:
    """``doc_id, k, duplicate_of, rows`` of every document whose text occurs in several rows, its smallest holder included; ``k`` is
    its ``text_key``, ``rows`` how often the document itself occurs."""
    hits = cut(suspected(digests(docs, pieces(docs.count(), SHARD_ROWS))))
    rows = whole(docs).withColumn("digest", digest_of(F.col("text")))
    held = rows.join(small(hits), "digest")
    # hits are verified against their contents: equal digest, then equal text
    groups = held.groupBy("digest", "text").agg(F.min("doc_id").alias("duplicate_of"))
    key = [F.col("digest"), text_key(F.col("text")).alias("k")]
    least = cut(groups.select(*key, "duplicate_of"))
    on = ["digest", "k"]
    if not least.groupBy(*on).count().filter("count > 1").isEmpty():  # two texts with 128 equal bits of hashes: compare the texts themselves
        least, on = cut(groups.select(*key, "text", "duplicate_of")), ["digest", "k", "text"]
    members = held.select("doc_id", *key, "text").select("doc_id", *on).groupBy("doc_id", *on).agg(F.count("*").alias("rows"))
    return members.join(small(least), on).select("doc_id", "k", "duplicate_of", "rows")


def duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, duplicate_of``: every copy with the smallest ``doc_id`` that has exactly its text."""
    return copies(docs).filter("doc_id <> duplicate_of").select("doc_id", "duplicate_of")


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with one row for each text. Rows with a null text or id stay."""
    found = cut(copies(docs))
    again = found.filter("doc_id = duplicate_of AND rows > 1")
    kept = drop_rows(docs, found.filter("doc_id <> duplicate_of OR rows > 1"))
    if again.isEmpty():
        return kept
    # a document in several rows leaves one of them
    key = (docs["doc_id"].cast("long") == again["doc_id"]) & (text_key(docs["text"]) == again["k"])
    return kept.unionByName(docs.join(small(again), key, "left_semi").dropDuplicates(["doc_id", "text"]))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(table(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id, duplicate_of FROM (
  SELECT DISTINCT doc_id, text, min(doc_id) OVER (PARTITION BY text) AS duplicate_of
  FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)
WHERE doc_id <> duplicate_of
"""
