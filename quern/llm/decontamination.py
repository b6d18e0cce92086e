"""Benchmark decontamination by template canonicalisation.

Texts become templates: numbers, names and units turn into typed placeholders, other words lose case and outer
punctuation; a name of several words is one placeholder. Windows of ``W`` template tokens are joined with the benchmark's by hash. Along one
alignment of a document with an item (one offset between their tokens) every slot value of the item must map to one value in
the document, as it does when a question was copied or re-parameterised; an alignment that breaks this is dropped.

A document is contaminated by an item when the consistent windows cover ``SHARE`` of the item's tokens, by ``FEWEST`` windows at least (by
all where the item has fewer), or when they cover ``RUN`` tokens of the item without a gap.

A name is a capitalised word of two letters or more inside a sentence; words in capitals only, and the first word of a sentence, are
ordinary. A window needs ``LITERAL`` ordinary words, so that placeholders alone are no evidence. An item without such a window
(a short or a number-heavy one) that has ``SHORTEST`` tokens or more is searched as one window of all its tokens, with its values.

Before the join a document's windows pass a Bloom filter of the benchmark's, so that next to nothing else leaves Python. The filter has
24 bits for each window of the benchmark and 128 MiB at most; beyond that more windows pass it, and the join decides.

Defined cases: null texts and ids never match; an item without windows that has fewer than ``SHORTEST`` tokens never matches; repeated rows
of either table count once; of a ``doc_id`` or ``item_id`` with several texts each text counts by itself, and ``decontaminate`` drops only the
contaminated ones; whole texts are searched, however long; other columns are carried along whatever their names; an empty table on
either side gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, cut, drop_rows, hash_strings, mix, ranges, slices, table, text_key, trim, words

W = 8
LITERAL = 5
SHARE = 0.5
FEWEST = 4
RUN = 25
SHORTEST = 5
#: bits of the Bloom filter for each window, bits that a window sets, and the filter's greatest size as a power of two
BLOOM_BITS, BLOOM_MARKS, BLOOM_MOST = 24, 4, 30

DROP, WORD, CAPITAL, NUMBER, UNIT = range(5)
UNITS = frozenset(
    "km m cm mm mi mile miles ft foot feet inch inches yd yard yards metre metres meter meters kilometre kilometres kilometer kilometers "
    "kg g mg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons tonne tonnes l ml litre litres liter liters gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "usd eur gbp dollar dollars euro euros cent cents percent degree degrees mph kph km/h m/s".split()
)
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:st|nd|rd|th|%)?$")
_MEASURE = re.compile(r"([+-]?\d[\d.,]*)([a-zA-Z/]+)$")
_OUTER = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’…–—¿¡·"
_INNER_KEEP = str.maketrans("", "", "$€£%+-")
_OUTER_NUMBER = _OUTER.translate(_INNER_KEEP)


def kind_of(token: str) -> tuple[int, str, bool]:
    """Kind, value, and whether a sentence ends after the token."""
    if token.isalpha():
        ends, core = False, token
    else:
        core = token.strip(_OUTER)
        tail = token[token.rfind(core) + len(core) :] if core else token
        ends = any(c in tail for c in ".!?…")
        if not core:
            return DROP, "", ends
        if any(c.isdigit() for c in core):
            number = token.strip(_OUTER_NUMBER)
            if _NUMBER.match(number):
                return NUMBER, number.rstrip(".,:/"), ends
            measure = _MEASURE.match(core)
            if measure and measure[2].lower() in UNITS:
                return NUMBER, core.lower(), ends
    low = core.lower()
    if low in UNITS:
        return UNIT, low, ends
    if len(core) > 1 and core[0].isupper() and not core.isupper():
        return CAPITAL, low, ends
    return WORD, low, ends


class Templates:
    """Canonical tokens of a slice of texts: hashes, slot codes and positions, all flat."""

    def __init__(self, texts: pa.Array):
        distinct, codes, offsets = words(texts, lower=False)
        found = [kind_of(w) for w in distinct]
        kind = np.array([k for k, _, _ in found], np.uint8)[codes] if found else np.zeros(0, np.uint8)
        ends = np.array([e for _, _, e in found], bool)[codes] if found else np.zeros(0, bool)
        h = mix(hash_strings([v for _, v, _ in found]))[codes] if found else np.zeros(0, U64)
        start = np.ones(len(codes), bool)
        start[1:] = ends[:-1]
        start[offsets[:-1][offsets[:-1] < len(codes)]] = True
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        keep = kind != DROP
        kind, start, h, doc = kind[keep], start[keep], h[keep], doc[keep]
        literal = (kind == WORD) | ((kind == CAPITAL) & start)
        # the words of one name are one slot, whose value is all of them
        more = np.zeros(len(kind), bool)
        name = (kind == CAPITAL) & ~literal
        more[1:] = name[1:] & name[:-1] & (doc[1:] == doc[:-1])
        first = np.flatnonzero(~more)
        place = np.arange(len(kind)) - np.repeat(first, np.diff(np.append(first, len(kind))))
        value = np.add.reduceat(mix(h + U64(0x9E3779B97F4A7C15) * (place.astype(U64) + U64(1))), first) if len(first) else h
        kind, literal, doc, h = kind[first], literal[first], doc[first], h[first]
        self.offsets = np.searchsorted(doc, np.arange(len(offsets)))
        self.slot = ~literal
        self.values = mix(value + kind.astype(U64))
        self.hash = np.where(literal, h, U64(0x9E3779B97F4A7C15) * kind.astype(U64))

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, first token and hash of every window with enough ordinary words."""
        many = np.maximum(np.diff(self.offsets) - W + 1, 0)
        at = ranges(self.offsets[:-1], many)
        doc = np.repeat(np.arange(len(many)), many)
        sums = np.concatenate([[0], np.cumsum(~self.slot)])
        keep = sums[at + W] - sums[at] >= LITERAL if len(at) else np.zeros(0, bool)
        at, doc = at[keep], doc[keep]
        g = np.zeros(len(at), U64)
        for k in range(W):
            g = mix(g + self.hash[at + k] + U64(k + 1))
        return doc, at, g

    def stretches(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, first token and hash of every stretch of ``n`` tokens, values included."""
        many = np.maximum(np.diff(self.offsets) - n + 1, 0)
        at = ranges(self.offsets[:-1], many)
        one = np.where(self.slot, self.values, self.hash)
        g = np.full(len(at), U64(n))
        for k in range(n):
            g = mix(g + one[at + k] + U64(k + 1))
        return np.repeat(np.arange(len(many)), many), at, g

    def slots(self, at: np.ndarray, length: np.ndarray) -> pa.ListArray:
        """The slot values of each window."""
        sums = np.concatenate([[0], np.cumsum(self.slot)])
        begin, count = sums[at], sums[at + length] - sums[at]
        flat = self.values[self.slot][ranges(begin, count)]
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(flat.view(np.int64)))


class Bloom:
    """Which windows may be the benchmark's: ``words`` of 64 bits, a power of two of them."""

    def __init__(self, words_: np.ndarray):
        self.words = words_

    @staticmethod
    def size(windows: int) -> int:
        """Bits, as a power of two."""
        return min(BLOOM_MOST, max(12, (BLOOM_BITS * windows).bit_length()))

    @staticmethod
    def marks(h: np.ndarray, bits: int) -> list[np.ndarray]:
        return [mix(h + U64(0xA5A5 * (k + 1))) >> U64(64 - bits) for k in range(BLOOM_MARKS)]

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """Places of the windows that pass."""
        at = np.arange(len(h))
        bits = int(len(self.words)).bit_length() + 5
        for k in range(BLOOM_MARKS):
            m = mix(h[at] + U64(0xA5A5 * (k + 1))) >> U64(64 - bits)
            at = at[(self.words[(m >> U64(6)).astype(np.int64)] >> (m & U64(63))) & U64(1) > 0]
        return at

    @classmethod
    def of(cls, windows: DataFrame, n: int) -> Bloom:
        """Of a table's column ``window``; bits are merged word by word before the driver gets them."""
        bits = cls.size(n)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                m = np.unique(np.concatenate(cls.marks(np.asarray(batch.column("window")).view(U64), bits)))
                yield pa.RecordBatch.from_arrays([pa.array((m >> U64(6)).astype(np.int64)), pa.array((U64(1) << (m & U64(63))).view(np.int64))], ["word", "mask"])

        out = np.zeros(1 << (bits - 6), U64)
        found = windows.select("window").mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
        out[np.asarray(found.column("word"))] = np.asarray(found.column("mask")).view(U64)
        return cls(out)


WINDOWS = "id long, k long, window long, pos int, length int, tokens int, exact boolean, slots array<long>"


def windows_of(rows: DataFrame, whole: bool = False, lengths: list[int] = (), passes=None) -> DataFrame:
    """Windows of ``rows`` (``id, text``).

    ``whole``: rows without any are one window. ``lengths``: stretches of these lengths besides. ``passes``: a broadcast ``Bloom`` to pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                t = Templates(part.column("text"))
                size = np.diff(t.offsets)
                found = [(*t.windows(), W, False)]
                if whole:
                    bare = np.setdiff1d(np.flatnonzero(size >= SHORTEST), found[0][0])
                    for n in np.unique(size[bare]).tolist():
                        doc, at, g = t.stretches(n)
                        own = np.isin(doc, bare) & (size[doc] == n)
                        found.append((doc[own], at[own], g[own], n, True))
                found += [(*t.stretches(n), n, True) for n in lengths]
                for doc, at, g, n, exact in found:
                    if passes is not None:
                        hit = passes.value(g)
                        doc, at, g = doc[hit], at[hit], g[hit]
                    for s in range(0, len(doc), 200_000):
                        d, a, h = doc[s : s + 200_000], at[s : s + 200_000], g[s : s + 200_000]
                        ids, ks = (part.column(c).to_numpy(zero_copy_only=False)[d] for c in ("id", "k"))
                        length = np.full(len(d), n, np.int32)
                        yield pa.RecordBatch.from_arrays(
                            [*(pa.array(x, pa.int64()) for x in (ids, ks)), pa.array(h.view(np.int64)), pa.array((a - t.offsets[d]).astype(np.int32)), pa.array(length), pa.array(size[d].astype(np.int32)), pa.array(np.full(len(d), exact)), t.slots(a, 0 * length if exact else length)],
                            ["id", "k", "window", "pos", "length", "tokens", "exact", "slots"],
                        )
        trim()

    return rows.filter("id IS NOT NULL AND text IS NOT NULL").select("id", text_key(F.col("text")).alias("k"), "text").mapInArrow(run, WINDOWS)


def found_in(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """``doc_id, k, item_id, n_windows, share, reparameterised`` for every document and item that it holds; ``k`` is its ``text_key``."""
    items = benchmark.select(benchmark["item_id"].cast("long").alias("id"), benchmark["text"].alias("text")).distinct()
    items = cut(windows_of(items, whole=True).distinct())
    of_item = items.groupBy(F.col("id").alias("item_id"), F.col("k").alias("item_k")).agg(F.countDistinct("pos").alias("windows"), F.max("tokens").alias("tokens"))
    lengths = sorted(r[0] for r in items.filter("exact").select("length").distinct().collect())
    passes = docs.sparkSession.sparkContext.broadcast(Bloom.of(items, items.count()))
    rows = docs.select(docs["doc_id"].cast("long").alias("id"), docs["text"].alias("text"))
    held = windows_of(rows, lengths=lengths, passes=passes).select(F.col("id").alias("doc_id"), "k", "window", "length", F.col("pos").alias("at"), F.col("slots").alias("held"))
    own = items.select(F.col("id").alias("item_id"), F.col("k").alias("item_k"), "window", "length", "pos", "slots")
    met = held.join(own, ["window", "length"]).filter(F.size("held") == F.size("slots"))
    key = ["doc_id", "k", "item_id", "item_k"]
    aligned = met.groupBy(*key, (F.col("at") - F.col("pos")).alias("offset")).agg(
        F.array_sort(F.collect_set(F.struct("pos", "length"))).alias("found"), F.array_distinct(F.flatten(F.collect_set(F.arrays_zip("slots", "held")))).alias("pairs")
    )
    consistent = aligned.filter(F.size("pairs") == F.size(F.array_distinct(F.col("pairs")["slots"])))
    changed = F.exists("pairs", lambda p: p["slots"] != p["held"])
    run = F.expr("""aggregate(found, struct(0 as a, 0 as b, 0 as best),
        (s, w) -> struct(if(w.pos <= s.b, s.a, w.pos) as a, w.pos + w.length as b, greatest(s.best, w.pos + w.length - if(w.pos <= s.b, s.a, w.pos)) as best), s -> s.best)""")
    total = consistent.withColumn("run", run).groupBy(*key).agg(F.flatten(F.collect_list("found")).alias("found"), F.max("run").alias("run"), F.max(changed).alias("reparameterised"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("found", lambda w: F.sequence(w["pos"], w["pos"] + w["length"] - 1)))))
    total = total.withColumn("n_windows", F.size(F.array_distinct("found"))).withColumn("covered", covered).join(of_item, ["item_id", "item_k"])
    ratio = F.col("covered") / F.col("tokens")
    held = total.filter(((ratio >= share) & (F.col("n_windows") >= F.least(F.lit(FEWEST), "windows"))) | (F.col("run") >= RUN))
    # of an item's several texts the one that is held most
    return held.groupBy("doc_id", "k", "item_id").agg(F.max(F.struct(ratio.alias("share"), "n_windows", "reparameterised")).alias("b")).select("doc_id", "k", "item_id", "b.n_windows", "b.share", "b.reparameterised")


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """``doc_id, item_id, n_windows, share, reparameterised`` for every document and item that it holds."""
    return found_in(docs, benchmark, share).drop("k")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without contaminated documents. Rows with a null id or text stay."""
    return drop_rows(docs, found_in(docs, benchmark).select("doc_id", "k"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
