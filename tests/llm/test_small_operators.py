"""Sharding, exact dedup, line dedup, token counts, BPE."""

import random

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from quern.llm import bpe, common, exact_dedup, line_dedup, sharding, token_counts
from quern.llm.exact_dedup import CuckooFilter

random.seed(4)


# -- sharding -------------------------------------------------------------------
def brute_shards(rows, limit):
    import hashlib

    h = lambda i: int(hashlib.md5(("null" if i is None else str(i)).encode()).hexdigest()[:8], 16)
    items = [(h(i), len((t or "").encode())) for i, t in rows]
    out, todo = {}, [(0, 0)]
    while todo:
        d, p = todo.pop()
        own = [(x, n) for x, n in items if x >> (32 - d) == p]
        size = sum(n for _, n in own)
        if own and (size <= limit or d == 32):
            for x, _ in own:
                out[x] = (format(p, f"0{d}b") if d else "", size, size > limit)
        elif own:
            todo += [(d + 1, 2 * p), (d + 1, 2 * p + 1)]
    return sorted((i is None, i or 0, len((t or "").encode()), *out[h(i)]) for i, t in rows)


@pytest.mark.parametrize("limit", [10, 700, 4000, 10**9])
def test_sharding(spark, docs_of, hard_rows, limit):
    rows = hard_rows + [(100 + k, "t" * random.randint(0, 600)) for k in range(150)]
    got = sharding.shard(docs_of(rows), limit).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["shard"], r["shard_bytes"], r["over_limit"]) for r in got) == brute_shards(rows, limit)
    assert sharding.shard(docs_of(rows).limit(0), limit).count() == 0


# -- exact dedup ----------------------------------------------------------------
def test_cuckoo_filter():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000)).astype(np.uint64)
    own = CuckooFilter(16)
    assert own.insert(keys).all() and own.resizes > 3 and not own.insert(keys).any() and len(own) == len(keys)
    assert own.contains(keys).all() and sorted(own.keys().tolist()) == keys.tolist()
    assert own.delete(keys[:2500]).all() and not own.delete(keys[:2500]).any()
    assert own.contains(keys[2500:]).all() and not own.contains(keys[:2500]).any()
    assert own.insert(np.repeat(keys[:2500], 2)).sum() == 2500
    back = CuckooFilter.of(own.row(3))
    assert back.contains(keys).all() and back.buckets == own.buckets


def test_overflow():
    """Keys of one fingerprint and bucket: more than two buckets hold, so the filter grows until other bits tell them apart."""
    same = (np.arange(11, dtype=np.uint64) << np.uint64(22)) | np.uint64((5 << 16) | 77)
    own = CuckooFilter(1)
    assert own.insert(same[:4]).all() and own.resizes == 0 and own.insert(same[4:]).all() and own.resizes > 0
    assert own.contains(same).all() and len(own) == 11 and not own.contains(same + np.uint64(1 << 50)).any()
    assert own.suspects(same + np.uint64(1 << 50)).all()  # a hit of the filter that the stored keys refute
    rng, live = np.random.default_rng(3), set()
    own = CuckooFilter(4)
    for _ in range(60):
        some = rng.integers(0, 3000, 90).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        if rng.random() < 0.6:
            assert own.insert(some).sum() == len(set(some.tolist()) - live)
            live |= set(some.tolist())
        else:
            assert own.delete(some).sum() == len(set(some.tolist()) & live)
            live -= set(some.tolist())
        assert sorted(own.keys().tolist()) == sorted(live)


def test_index_table(spark, docs_of):
    docs = docs_of([(k, f"text {k % 40}") for k in range(60)])
    d = exact_dedup.digests(docs, 4)
    index = exact_dedup.insert_digests(exact_dedup.empty_index(spark), d)
    live = lambda t: sum(len(CuckooFilter.of(r.asDict())) for r in t.collect())
    assert live(index) == 40 and exact_dedup.known(index, d).count() == 40
    fewer = exact_dedup.delete_digests(index, d.filter("doc_id < 10"))
    assert live(fewer) == 30 and exact_dedup.known(fewer, d).count() == 30 and live(exact_dedup.insert_digests(fewer, d)) == 40


def test_exact_dedup(docs_of, hard_rows):
    rows = hard_rows + [(20, "same"), (19, "same"), (21, "same"), (22, "Same"), (21, "another text of one id")]
    docs = docs_of(rows)
    assert {tuple(r) for r in exact_dedup.duplicates(docs).collect()} == {(5, 1), (20, 19), (21, 19)}
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect())
    want = sorted([(i or 0, t or "") for i, t in hard_rows if i not in (1, 5)] + [(1, hard_rows[0][1]), (19, "same"), (22, "Same"), (21, "another text of one id")])
    assert got == want
    assert exact_dedup.duplicates(docs.limit(0)).count() == 0 and exact_dedup.deduplicate(docs.limit(0)).count() == 0


# -- line dedup -----------------------------------------------------------------
def brute_lines(rows):
    seen, out = set(), {}
    for i, t in sorted({(i, t) for i, t in rows if i is not None and t is not None}):
        keep = []
        for line in t.split("\n"):
            bare = line.strip()
            if not bare or bare not in seen:
                keep.append(line)
            seen.add(bare)
        out[i, t] = "\n".join(keep)
    return sorted((i or 0, out.get((i, t), t) or "", 0 if t is None else t.count("\n") + 1) for i, t in rows)


def test_line_dedup(docs_of, hard_rows):
    pool = [f"line {k}" for k in range(30)] + ["", "  line 3 "]
    rows = hard_rows + [(100 + k, "\n".join(random.choices(pool, k=random.randint(1, 12)))) for k in range(60)]
    got = line_dedup.dedup_lines(docs_of(rows))
    assert sorted((r["doc_id"] or 0, r["text"] or "", r["n_lines"]) for r in got.collect()) == brute_lines(rows)
    assert line_dedup.dedup_lines(docs_of(rows).limit(0)).count() == 0


def test_in_many_shards(docs_of, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_BYTES", 100)
    monkeypatch.setattr(exact_dedup, "SHARD_ROWS", 5)
    monkeypatch.setattr(exact_dedup, "AT_ONCE", 7)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    rows = [(k, "\n".join(random.choices([f"line {j}" for j in range(9)], k=2))) for k in range(200)]
    got = line_dedup.dedup_lines(docs_of(rows))
    assert sorted((r["doc_id"], r["text"], r["n_lines"]) for r in got.collect()) == brute_lines(rows)
    least = {}
    for i, t in rows:
        least.setdefault(t, i)
    assert {tuple(r) for r in exact_dedup.duplicates(docs_of(rows)).collect()} == {(i, least[t]) for i, t in rows if least[t] != i}
    assert sorted(r["doc_id"] for r in exact_dedup.deduplicate(docs_of(rows + rows[:3])).collect()) == sorted(least.values())


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(2).integers(0, 2**63, 20_000).astype(np.uint64))
    h = line_dedup.PerfectHash.load(line_dedup.PerfectHash.build(keys).dump())
    assert sorted(h.slots(keys).tolist()) == list(range(len(keys)))
    none = line_dedup.PerfectHash.load(line_dedup.PerfectHash.build(keys[:0]).dump())
    assert none.size == 0 and (none.slots(keys[:5]) == -1).all()


def test_foreign_lines(docs_of):
    """An index serves other documents: lines that it never saw stay."""
    index = line_dedup.build_index(line_dedup.probes(docs_of([(1, "a\nb"), (2, "a")]), 2))
    hits = line_dedup.probe(line_dedup.probes(docs_of([(5, "a\nb\nc\nd")]), 2), index)
    assert [(r["doc_id"], r["line"]) for r in hits.collect()] == [(5, 0)]


def test_lines_of_one_hash(docs_of, monkeypatch):
    """Lines whose 64-bit hashes are equal are told apart by their fingerprints."""
    real = line_dedup.hash_strings
    rows = [(k, "\n".join(random.choices([f"line {j}" for j in range(9)], k=3))) for k in range(60)]
    monkeypatch.setattr(line_dedup, "hash_strings", lambda x: real(x) % np.uint64(3))
    lines = line_dedup.line_hashes(pa.array([t for _, t in rows]))
    assert len(set(lines[2].tolist())) <= 3 and len(set(lines[3].tolist())) == 9
    payload = line_dedup.pack(lines[2], lines[3], np.array([rows[k][0] for k in lines[0]]), np.zeros(len(lines[0]), np.int64), lines[1].astype(np.uint32))
    frame = docs_of(rows).sparkSession.createDataFrame([(0, bytearray(payload))], line_dedup.PROBES)
    got = {(r["doc_id"], r["line"]) for r in line_dedup.probe(frame, line_dedup.build_index(frame)).collect()}
    seen, want = set(), set()
    for i, t in rows:
        for n, line in enumerate(t.split("\n")):
            if line in seen:
                want.add((i, n))
            seen.add(line)
    assert got == want


# -- tokens ---------------------------------------------------------------------
def reference():
    return tiktoken.Encoding("own", pat_str=token_counts.PATTERN, mergeable_ranks=token_counts.load_ranks(token_counts.VOCABULARY), special_tokens={})


def test_token_counts(docs_of, hard_rows):
    rows = hard_rows + [(50, "don't  stop\n\n  I'll 123,456 <|endoftext|> aaaaaaaaa  x")]
    enc = reference()
    want = sorted((i or 0, len(enc.encode_ordinary(t)) if t else 0) for i, t in rows)
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in token_counts.token_counts(docs_of(rows)).collect()) == want


def test_merge_all():
    enc, pairs = reference(), token_counts.pair_table(token_counts.VOCABULARY)
    words = [bytes(random.choices(b"abcdefgh \xc3\xa9", k=random.randint(1, 40))) for _ in range(3000)]
    assert token_counts.merge_all(pairs, words).tolist() == [len(enc._encode_single_piece(w)) for w in words]


def test_tree_concatenation():
    enc = reference()
    for text in ("a" * 9000, "ab" * 5000, "".join(random.choices("abcdeñé", k=9000)), "".join(random.choices(["the", "ing", "tion"], k=3000))):
        for leaf in (64, 1000):
            assert bpe.encode_text(text, leaf=leaf) == enc.encode_ordinary(text)
    parts = ["a", "b", " ", "  ", "\n", "'", "re", "s", "'ll", "1", "23", "é", "漢", "!", "?!", "the", "\t", " \n ", "x" * 30, "ab" * 40, "y" * 700]
    for k in range(120):  # cuts at every kind of place
        text = "".join(random.choices(parts, k=random.randint(1, 60)))
        assert bpe.encode_text(text, leaf=1 + k % 20) == enc.encode_ordinary(text)


def test_bpe(docs_of, hard_rows, monkeypatch):
    rows = hard_rows + [(60, "foo\n\n" + "x" * 300 + "  bar \n" + "yz" * 200 + " end "), (61, "ab " * 100 + " " * 400 + "q")]
    enc = reference()
    monkeypatch.setattr(bpe, "ARITY", 8)
    out = bpe.encode(docs_of(rows), long=100, leaf=40)
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or [])
    got = sorted([(r["doc_id"], r["tokens"]) for r in out.collect()], key=key)
    assert got == sorted([(i, None if t is None else enc.encode_ordinary(t)) for i, t in rows], key=key)
    assert out.filter(~F.col("round_trip")).count() == 0
    texts = sorted((r["doc_id"] or 0, r["text"] or "") for r in bpe.decode(out).collect())
    assert texts == sorted((i or 0, t or "") for i, t in rows)
    assert bpe.encode(docs_of(rows).limit(0)).count() == 0
