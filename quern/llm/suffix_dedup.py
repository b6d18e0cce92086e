"""Repeated passages by prefix-free parsing.

The text is a sequence of words. A rolling hash over ``W`` words triggers the end of a phrase (one window in ``P``); a
phrase begins with the trigger window of the one before, so no phrase suffix of ``W`` words or more is a prefix of another.
The suffixes of the corpus then sort by the suffix of the phrase that they begin in, and after it by the parse: what
follows the phrase. Neighbours in this order that agree for ``L`` words are a repeat, and every repeat of ``L`` words shows
between neighbours.

1. All phrases of the corpus are counted by hash, in buckets. Two copies of a passage share its inner phrases, so only
   stretches of phrases that occur twice (and phrases so long that a passage may hide in them), with what they touch on both
   sides, can hold a repeat. Other text leaves here, unique text nearly all.
2. The stretches that are left are parsed again. A phrase goes, with the words that follow it, to the bucket of its trigger
   window: all suffixes that begin with the same ``L`` words meet in one bucket. There the dictionary's suffix array and the
   parse's (with its LCP array and range minima) combine into the order of that part of the corpus.
3. A suffix with no trigger within ``L`` words has no such bucket; it is compared by a hash of its ``L`` words instead.

Words are ordered by a code of 32 bits instead of by letters: which of two different ones comes first doesn't matter here. They are
stretches between white space, with their case.

The result has one row for every maximal stretch of a document whose words all lie in repeats (of this document or another):
``doc_id, start_word, end_word`` (exclusive), ``n_words``.

Defined cases: texts of fewer than ``L`` words have no repeats; null texts and ids have none; whole texts count, however long; other columns are
ignored, whatever their names; rows that repeat both id and text are one
document; rows of one id with other texts are compared like other documents; passages may overlap themselves; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, bits_for, cut, hash_strings, mix, pack, ranges, runs, six, slices, table, text_bytes, trim, unpack, unsix, words

L = 50
W = 4
P = 6
#: bytes of text for each bucket of phrases
BUCKET_BYTES = 28 << 20
#: regions are broadcast up to this many bytes
BROADCAST_BYTES = 32 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


class RangeHash:
    """Hashes of any range of a word sequence, from prefix sums."""

    def __init__(self, h: np.ndarray):
        n = len(h)
        power = np.cumprod(np.concatenate([[U64(1)], np.full(n, U64(_BASE))]))
        self.back = np.cumprod(np.concatenate([[U64(1)], np.full(n, U64(_INVERSE))]))
        self.sums = np.concatenate([[U64(0)], np.cumsum(h * power[:n])])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(U64) * U64(0xD1B54A32D192ED03))


class Parse:
    """Word hashes of a slice of texts and the triggers in it."""

    def __init__(self, texts: pa.Array):
        distinct, codes, self.offsets = words(texts, lower=False)
        self.h = mix(hash_strings(distinct))[codes] if len(codes) else np.zeros(0, U64)
        n = len(self.h)
        self.range = RangeHash(self.h)
        self.trigger = np.zeros(n, bool)
        if n >= W:
            ends = np.arange(W, n + 1)
            self.trigger[W - 1 :] = self.range(ends - W, ends) % U64(P) == 0
        self.doc = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))
        first = self.offsets[:-1][self.doc] if n else np.zeros(0, np.int64)
        self.trigger &= np.arange(n) - first >= W - 1


def phrases(p: Parse, least: int) -> tuple[np.ndarray, ...]:
    """Document, first new word (from the document's start), new words, hash, and the neighbours' lengths, of each phrase."""
    size = np.diff(p.offsets)
    end = p.trigger.copy()
    some = size > 0
    end[p.offsets[1:][some] - 1] = True
    last = np.flatnonzero(end)
    last = last[size[p.doc[last]] >= least]
    doc = p.doc[last]
    begin = np.zeros(len(last), np.int64)
    begin[1:] = last[:-1] + 1
    fresh = np.ones(len(last), bool)
    fresh[1:] = doc[1:] != doc[:-1]
    begin[fresh] = p.offsets[doc[fresh]]
    length = last + 1 - begin
    whole = np.where(fresh, begin, begin - W + 1 - 1)
    whole = np.maximum(whole, p.offsets[doc])
    code = p.range(whole, last + 1)
    before, after = np.zeros(len(last), np.int64), np.zeros(len(last), np.int64)
    before[1:] = np.where(fresh[1:], 0, length[:-1])
    after[:-1] = np.where(fresh[1:], 0, length[1:])
    return doc, begin - p.offsets[doc], length, code, before, after


def _blobs(bucket: np.ndarray, doc: np.ndarray, keys: list[np.ndarray], columns: list[np.ndarray], out: list, payloads: list, add: int = 0) -> None:
    """Cut rows (sorted by document) into one payload for each bucket: keys once for each document, columns for each row."""
    order = np.argsort(bucket, kind="stable")
    bucket, doc = bucket[order], doc[order]
    columns = [c[order] for c in columns]
    for s, c in zip(*runs(bucket)):
        at, n = runs(doc[s : s + c])
        d = doc[s + at]
        out.append(int(bucket[s]) + add)
        payloads.append(pack(*(k[d] for k in keys), n.astype(np.uint32), *(six(x[s : s + c]) if x.dtype == U64 else x[s : s + c] for x in columns)))


def _top(x: np.ndarray, bits: int, of: int = 64) -> np.ndarray:
    x = x.view(U64) if x.dtype == np.int64 else x
    top = (x >> U64(of - bits)) if bits else np.zeros(len(x), U64)
    return top.astype(np.uint16 if bits <= 16 else np.int64)


def _batch(out: list, payloads: list, names: tuple[str, str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(out, pa.int32()), pa.array(payloads, pa.binary())], list(names))


def _phrases(bits: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                doc, start, length, code, before, after = phrases(Parse(part.column("text")), least)
                k = np.asarray(part.column("k"))
                out, payloads = [], []
                code = code >> U64(16)
                columns = [code, start.astype(np.uint32), length.astype(np.uint32), np.minimum(before, 255).astype(np.uint8), np.minimum(after, 255).astype(np.uint8)]
                _blobs(_top(code, bits, 48), doc, [k], columns, out, payloads)
                yield _batch(out, payloads, ("bucket", "payload"))
        trim()

    return run


def _shared(bits: int, least: int):
    """Of a bucket of phrases those that occur twice or are long, sent on to their documents."""
    long = least // 2 - W - 1

    def run(rows: pa.Table) -> pa.Table:
        k, count, code, start, length, before, after = (np.concatenate(x) for x in zip(*(unpack(p.as_py(), "i8", "u4", "u1", "u4", "u4", "u1", "u1") for p in rows.column("payload"))))
        code, k = unsix(code), np.repeat(k, count)
        order = np.lexsort((start, k, code))
        code, k, start = code[order], k[order], start[order]
        new = np.ones(len(code), bool)  # a repeated row isn't another occurrence
        new[1:] = (code[1:] != code[:-1]) | (k[1:] != k[:-1]) | (start[1:] != start[:-1])
        order, code, k, start = order[new], code[new], k[new], start[new]
        _, many = runs(code)
        length = length[order]
        keep = np.repeat(many > 1, many) | (length >= long)
        order, k, start, length = order[keep], k[keep], start[keep], length[keep]
        by = np.argsort(k, kind="stable")
        k, order, start, length = k[by], order[by], start[by], length[by]
        ks, number = np.unique(k, return_inverse=True)
        out, payloads = [], []
        _blobs(_top(k, bits), number, [ks], [start, length, before[order], after[order]], out, payloads)
        trim()
        return pa.Table.from_batches([_batch(out, payloads, ("home", "payload"))])

    return run


def merged(k: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of the ranges of each ``k`` that touch."""
    order = np.lexsort((start, k))
    k, start, end = k[order], start[order], end[order]
    if not len(k):
        return k, start, end
    first = np.ones(len(k), bool)
    first[1:] = k[1:] != k[:-1]
    group = np.cumsum(first)
    span = int(end.max()) + 1
    reach = np.maximum.accumulate(group * span + end)  # the furthest end so far in this k
    new = first.copy()
    new[1:] |= group[1:] * span + start[1:] > reach[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(k)) - 1
    return k[at], start[at], reach[last] - group[last] * span


def _regions(least: int):
    """Stretches of kept phrases with what they touch, long enough for a repeat."""

    def run(rows: pa.Table) -> pa.Table:
        k, count, start, length, before, after = (np.concatenate(x) for x in zip(*(unpack(p.as_py(), "i8", "u4", "u4", "u4", "u1", "u1") for p in rows.column("payload"))))
        k = np.repeat(k, count)
        start, length, before, after = (x.astype(np.int64) for x in (start, length, before, after))
        order = np.lexsort((start, k))
        k, start, length, before, after = (x[order] for x in (k, start, length, before, after))
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (start[1:] != start[:-1] + length[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(k)) - 1
        begin = np.maximum(0, start[first] - before[first] - W)
        end = start[last] + length[last] + after[last]
        keep = end - begin >= least
        k, begin, end = merged(k[first][keep], begin[keep], end[keep])
        at, n = runs(k)
        offsets = pa.array(np.append(at, len(k)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (begin, end)]
        return pa.table([pa.array(k[at]), *lists], ["k", "begins", "ends"])

    return run


def _suffixes(bits: int, least: int):
    """Parse the regions again: suffixes by the trigger window of their phrase, or by a hash where none is near."""
    top = 1 << bits
    tail = least - W

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                p = Parse(part.column("text"))
                size = np.diff(p.offsets)
                begins, ends = (part.column(c).to_pylist() for c in ("begins", "ends"))
                row = np.repeat(np.arange(len(begins)), [len(b) for b in begins])
                begin = np.array([x for b in begins for x in b], np.int64)
                end = np.minimum(np.array([x for b in ends for x in b], np.int64), size[row])
                many = np.maximum(end - begin - least + 1, 0)
                at = ranges(p.offsets[row] + begin, many)  # every suffix that has L words in its region
                if not len(at):
                    continue
                n = len(p.h)
                where = np.where(p.trigger, np.arange(n), n + least)
                next_ = np.minimum.accumulate(where[::-1])[::-1]
                t = next_[at + W - 1]
                ids, ks = np.asarray(part.column("doc_id")), np.asarray(part.column("k"))
                out, payloads = [], []
                near = t < at + least
                far = at[~near]
                if len(far):
                    code = p.range(far, far + least)
                    _blobs(_top(code, bits), p.doc[far], [ids, ks], [code.view(np.int64), (far - p.offsets[p.doc[far]]).astype(np.uint32)], out, payloads, top)
                at, t = at[near], t[near]
                new = np.ones(len(at), bool)
                new[1:] = (t[1:] != t[:-1]) | (at[1:] != at[:-1] + 1)
                lo = at[new]
                if len(lo):
                    t = t[new]
                    count = np.diff(np.append(np.flatnonzero(new), len(at)))
                    hi = lo + count - 1
                    bucket = _top(p.range(t - W + 1, t + 1), bits)
                    order = np.argsort(bucket, kind="stable")
                    w = (p.h >> U64(32)).astype(np.uint32)
                    for s, c in zip(*runs(bucket[order])):
                        g = order[s : s + c]
                        alpha = t[g] - lo[g] + 1
                        follow = t[g][:, None] + 1 + np.arange(tail)
                        known = follow <= (hi[g] + least - 1)[:, None]
                        follow = np.where(known, w[np.minimum(follow, n - 1)], 0).astype(np.uint32)
                        out.append(int(bucket[g[0]]))
                        d = p.doc[lo[g]]
                        payloads.append(pack(ids[d], ks[d], (lo[g] - p.offsets[d]).astype(np.uint32), count[g].astype(np.uint8), alpha.astype(np.uint8), w[ranges(lo[g], alpha)], follow.reshape(-1)))
                if out:
                    yield _batch(out, payloads, ("bucket", "payload"))
        trim()

    return run


def dictionary_order(flat: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of a dictionary, by prefix doubling over its distinct phrases (ranges of ``flat``).

    Gives, for each phrase, where it stands in the dictionary, and the rank of every suffix there: by the words' codes, word after
    word. Equal suffixes have equal ranks.
    """
    code = RangeHash(flat.astype(U64))(begin, begin + length)
    _, first, number = np.unique(code, return_index=True, return_inverse=True)
    size = length[first]
    start = np.cumsum(size) - size
    left = np.repeat(start + size, size) - np.arange(int(size.sum()))  # words to the end of the phrase
    rank = np.unique(flat[ranges(begin[first], size)], return_inverse=True)[1] + 1
    step, most = 1, int(size.max(initial=0))
    while step < most:
        after = np.zeros(len(rank), np.int64)
        more = np.flatnonzero(left > step)
        after[more] = rank[more + step]
        rank = np.unique(rank * (len(rank) + 1) + after, return_inverse=True)[1] + 1
        step *= 2
    return start[number], rank


class RangeMinimum:
    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while len(values) > (1 << len(self.rows)):
            a, half = self.rows[-1], 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(a[:-half], a[half:]))

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minimum over ``lo..hi``, both included."""
        level = np.frexp(hi - lo + 1)[1] - 1
        out = np.empty(len(lo), self.rows[0].dtype)
        for k, row in enumerate(self.rows):
            pick = level == k
            out[pick] = np.minimum(row[lo[pick]], row[hi[pick] - (1 << k) + 1])
        return out


HITS = "doc_id long, k long, a int, b int"


def _order(bits: int, least: int):
    """The part of the corpus order that a bucket holds; ``a..b`` are first words of suffixes repeated for L words."""
    top, tail = 1 << bits, least - W

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        if key[0].as_py() >= top:
            ids, ks, count, code, pos = (np.concatenate(x) for x in zip(*(unpack(p.as_py(), "i8", "i8", "u4", "i8", "u4") for p in rows.column("payload"))))
            ids, ks, pos = np.repeat(ids, count), np.repeat(ks, count), pos.astype(np.int64)
            order = np.lexsort((pos, ks, code))
            ids, ks, code, pos = ids[order], ks[order], code[order], pos[order]
            new = np.ones(len(ids), bool)
            new[1:] = (code[1:] != code[:-1]) | (ks[1:] != ks[:-1]) | (pos[1:] != pos[:-1])
            ids, ks, code, pos = ids[new], ks[new], code[new], pos[new]
            _, many = runs(code)
            hit = np.repeat(many > 1, many)
        else:
            ids, ks, lo, count, alpha, flat, follow = (np.concatenate(x) for x in zip(*(unpack(p.as_py(), "i8", "i8", "u4", "u1", "u1", "u4", "u4") for p in rows.column("payload"))))
            follow = follow.reshape(-1, tail)
            lo, count, alpha = (x.astype(np.int64) for x in (lo, count, alpha))
            begin = np.cumsum(alpha) - alpha
            order = np.lexsort((lo, ks))
            new = np.ones(len(order), bool)  # repeated rows once
            new[1:] = (ks[order][1:] != ks[order][:-1]) | (lo[order][1:] != lo[order][:-1])
            g = order[new]
            # suffix array of the parse, cut at L words, its LCP array and range minima
            raw = np.ascontiguousarray(follow[g].astype(">u4")).view(f"V{4 * tail}").reshape(-1)
            sorted_, rank = np.unique(raw, return_inverse=True)
            grid = np.frombuffer(sorted_.tobytes(), ">u4").reshape(-1, tail)
            lcp = np.zeros(len(grid), np.int64)
            for s in range(1, len(grid), 100_000):
                e = min(len(grid), s + 100_000)
                differ = grid[s:e] != grid[s - 1 : e - 1]
                lcp[s:e] = np.where(differ.any(1), differ.argmax(1), tail)
            least_of = RangeMinimum(lcp)
            # suffixes of the dictionary: one entry for each first word, with the rank of the rest of its phrase
            place, ranks = dictionary_order(flat, begin[g], alpha[g])
            owner = np.repeat(np.arange(len(g)), count[g])
            at = ranges(begin[g], count[g])
            code, length = ranks[place[owner] + at - begin[g][owner]], (begin[g] + alpha[g])[owner] - at
            order = np.lexsort((rank[owner], code))
            owner, code, length, at = owner[order], code[order], length[order], at[order]
            r = rank[owner]
            same = code[1:] == code[:-1]
            common = np.full(len(same), tail, np.int64)
            differ = np.flatnonzero(same & (r[1:] != r[:-1]))
            common[differ] = least_of(r[:-1][differ] + 1, r[1:][differ])
            agree = same & (length[1:] + common >= least)
            hit = np.zeros(len(owner), bool)
            hit[1:] |= agree
            hit[:-1] |= agree
            pos = lo[g][owner] + at - begin[g][owner]
            ids, ks = ids[g][owner], ks[g][owner]
        ids, ks, pos = ids[hit], ks[hit], pos[hit]
        order = np.lexsort((pos, ks))
        ids, ks, pos = ids[order], ks[order], pos[order]
        new = np.ones(len(pos), bool)
        new[1:] = (ks[1:] != ks[:-1]) | (pos[1:] != pos[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(pos)) - 1 if len(pos) else first
        trim()
        return pa.table([pa.array(ids[first]), pa.array(ks[first]), pa.array(pos[first].astype(np.int32)), pa.array(pos[last].astype(np.int32))], ["doc_id", "k", "a", "b"])

    return run


def repeats(docs: DataFrame, least: int = L) -> DataFrame:
    """``doc_id, start_word, end_word, n_words`` of every stretch of repeats of ``least`` words or more (20 to 255)."""
    if not 20 <= least <= 255:
        raise ValueError("least must be between 20 and 255")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    rows = rows.withColumn("k", F.xxhash64("doc_id", "text"))
    bits = bits_for(text_bytes(docs), BUCKET_BYTES)
    found = rows.select("k", "text").mapInArrow(_phrases(bits, least), "bucket int, payload binary")
    shared = found.groupBy("bucket").applyInArrow(_shared(bits, least), "home int, payload binary")
    regions = cut(shared.groupBy("home").applyInArrow(_regions(least), "k long, begins array<int>, ends array<int>"))
    size = regions.agg(F.sum(8 * F.size("begins") + 32)).first()[0] or 0
    held = rows.join(F.broadcast(regions) if size <= BROADCAST_BYTES else regions, "k").select("doc_id", "k", "text", "begins", "ends")
    fine = bits + 2  # a suffix weighs more than a phrase
    suffixes = held.mapInArrow(_suffixes(fine, least), "bucket int, payload binary")
    hits = suffixes.groupBy("bucket").applyInArrow(_order(fine, least), HITS)

    def spans(batch: pa.Table) -> pa.Table:
        ids, k, a, b = (np.asarray(batch.column(c)).astype(np.int64) for c in ("doc_id", "k", "a", "b"))
        ks, first, number = np.unique(k, return_index=True, return_inverse=True)
        owner, start, end = merged(number, a, b + least)
        return pa.table([pa.array(ids[first][owner]), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array((end - start).astype(np.int32))], ["doc_id", "start_word", "end_word", "n_words"])

    home = F.shiftrightunsigned("k", 64 - bits).cast("int") if bits else F.lit(0)
    return hits.withColumn("home", home).groupBy("home").applyInArrow(spans, "doc_id long, start_word int, end_word int, n_words int")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))


SQL = f"""
WITH w AS (
  SELECT DISTINCT doc_id, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
p AS (
  SELECT d, doc_id, unnest(list_transform(range(0, len(w) - {L - 1}), lambda i: array_to_string(w[i + 1:i + {L}], ' '))) AS s, unnest(range(0, len(w) - {L - 1})) AS p
  FROM (SELECT row_number() OVER () AS d, * FROM w) WHERE len(w) >= {L}),
h AS (SELECT d, doc_id, p FROM (SELECT d, doc_id, p, count(*) OVER (PARTITION BY s) AS n FROM p) WHERE n > 1),
g AS (SELECT *, sum(CASE WHEN p - before <= {L} THEN 0 ELSE 1 END) OVER (PARTITION BY d ORDER BY p) AS g FROM (SELECT *, lag(p) OVER (PARTITION BY d ORDER BY p) AS before FROM h))
SELECT doc_id, CAST(min(p) AS INTEGER) AS start_word, CAST(max(p) + {L} AS INTEGER) AS end_word, CAST(max(p) + {L} - min(p) AS INTEGER) AS n_words FROM g GROUP BY d, doc_id, g
"""
