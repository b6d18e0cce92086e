"""Repeated passages, decontamination, n-gram join, quality, HTML, the pipeline and the registered queries."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from oracle import same
from pyspark.sql import functions as F

from quern.llm import bpe, common, decontamination, exact_dedup, html_extraction, line_dedup, ngram_jaccard, quality, sharding, suffix_dedup, token_counts
from quern.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    same(spark, SF, QUERIES[name], ORACLE_SQL[name])


# -- repeated passages ----------------------------------------------------------
def brute_repeats(rows, least):
    where = collections.defaultdict(set)
    docs = {(i, t) for i, t in rows if i is not None and t is not None}
    for i, t in docs:
        w = t.split()
        for p in range(len(w) - least + 1):
            where[tuple(w[p : p + least])].add((i, t, p))
    flagged = collections.defaultdict(set)
    for v in where.values():
        if len(v) > 1:
            for i, t, p in v:
                flagged[i, t].update(range(p, p + least))
    out = []
    for (i, _), f in flagged.items():
        f = sorted(f)
        starts = [x for x in f if x - 1 not in set(f)] if len(f) < 3000 else [f[0]]
        for a in starts:
            e = a
            s = set(f)
            while e in s:
                e += 1
            out.append((i, a, e))
    return sorted(out)


@pytest.mark.parametrize("least", [20, 33, 50])
def test_suffix_dedup(docs_of, hard_rows, least):
    rng = random.Random(least)
    rows = list(hard_rows)
    for k in range(100):
        w = [f"w{rng.randrange(200)}" for _ in range(rng.randrange(150))]
        if k % 3 == 0:
            src = rng.choice(rows[12:] or [(0, "a b")])[1].split()
            a = rng.randrange(max(1, len(src)))
            w = w[:40] + src[a : a + rng.randrange(15, 60)] + w[40:]
        rows.append((100 + k, " ".join(w)))
    got = sorted((r["doc_id"], r["start_word"], r["end_word"]) for r in suffix_dedup.repeats(docs_of(rows), least).collect())
    assert got == brute_repeats(rows, least) and got
    assert suffix_dedup.repeats(docs_of(rows).limit(0), least).count() == 0


# -- n-gram join ----------------------------------------------------------------
def sets_of(text, n=3):
    w = text.lower().split()
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def brute_classes(rows, t=0.5):
    """Class and links of every document (id and text) in a pair, all documents compared with all."""
    own = sorted({(i, x) for i, x in rows if i is not None and x is not None and x.split()})
    sets, parent, links = [sets_of(x) for _, x in own], list(range(len(own))), collections.Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, s in enumerate(sets):
        for b in range(a + 1, len(own)):
            if min(len(s), len(sets[b])) >= t * max(len(s), len(sets[b])) and len(s & sets[b]) / len(s | sets[b]) >= t:
                links[a] += 1
                links[b] += 1
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {own[k]: (own[find(k)][0], links[k]) for k in links}


def found_classes(spark, docs, rows):
    texts = {(i, k): t for i, t, k in docs.selectExpr("doc_id", "text", "xxhash64(text)").collect()}
    got = [((r["doc_id"], texts[r["doc_id"], r["k"]]), (r["class_id"], r["n_links"])) for r in ngram_jaccard.classes(docs).collect()]
    assert len(got) == len(dict(got))
    return dict(got)


def near_rows():
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefghijklmnop") + rng.choice("xyz") for _ in range(60)) for _ in range(4)]
    rows = []
    for i in range(260):  # groups of more than 64 and passages that many share: hot n-grams
        w = base[i % 4].split() if i % 3 else [rng.choice("qrstuv") + rng.choice("abcdefgh") for _ in range(40)] + base[0].split()[:25]
        for _ in range(rng.randint(0, 7)):
            w[rng.randrange(len(w))] = f"zz{rng.randint(0, 50)}"
        rows.append((100 + i, " ".join(w)))
    return rows


def kept_rows(rows, want):
    """Of each class the row of the smallest id, and all rows in no class."""
    least = {}
    for (i, x), (c, _) in want.items():
        if i == c:
            least.setdefault(c, []).append(x)
    return [(i, x) for i, x in rows if (i, x) not in want or (i == want[i, x][0] and len(least[i]) == 1)]


def some(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def test_ngram_join(spark, docs_of, hard_rows):
    text, near = (" ".join(f"{c}{k}" for k in range(40)) for c in "ab")
    near = " ".join(text.split()[:36] + near.split()[:4])
    rows = hard_rows + near_rows() + [(500, "short"), (501, "SHORT"), (502, "two words"), (503, "two  words ")]
    rows += [(700 + k, text) for k in range(5)] + [(k, near) for k in (690, 697, 705, 708)]
    docs = docs_of(rows)
    want = brute_classes(rows)
    assert found_classes(spark, docs, rows) == want and len(want) > 150
    kept = ngram_jaccard.keep_one(docs)
    assert some((r["doc_id"], r["text"]) for r in kept.collect()) == some(kept_rows(rows, want)) and kept.columns == docs.columns
    assert ngram_jaccard.classes(docs.limit(0)).count() == 0 and ngram_jaccard.keep_one(docs.limit(0)).count() == 0


@pytest.mark.parametrize("block", [1000, 1 << 24])
def test_ngram_join_in_many_buckets(spark, docs_of, monkeypatch, block):
    """Buckets, fragments, blocks and batches of a large input, on a small one."""
    for name, value in (("BUCKET_BYTES", 4000), ("FRAGMENT_BYTES", 10_000), ("BLOCK_BYTES", block), ("PAIRS_AT_ONCE", 500), ("HOT_PAIRS", 300)):
        monkeypatch.setattr(ngram_jaccard, name, value)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    rows = near_rows()
    docs = docs_of(rows).repartition(6)
    assert found_classes(spark, docs, rows) == brute_classes(rows)


def test_segments_are_small_and_sent_once(spark, docs_of, monkeypatch):
    """What near copies send to fragments grows neither with their n-grams nor, through blocks, with the number of fragments."""
    monkeypatch.setattr(ngram_jaccard, "FRAGMENT_BYTES", 3000)
    monkeypatch.setattr(ngram_jaccard, "BLOCK_BYTES", 4000)
    seen, cut_up = [], ngram_jaccard._blocks

    def counted(segments):
        out = cut_up(segments)
        size = lambda d: d.selectExpr("coalesce(sum(octet_length(payload)), 0)", "count(DISTINCT fragment)", "count(*)").first()
        seen.append((size(segments), size(out)))
        return out

    monkeypatch.setattr(ngram_jaccard, "_blocks", counted)
    rows = []
    for k in range(120):
        text = [f"d{k}w{j}" for j in range(400)]
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join([*text[:200], "changed", *text[201:]]))]
    assert found_classes(spark, docs_of(rows), rows) == {row: (row[0] // 2 * 2, 1) for row in rows}
    ((n_bytes, fragments, _), sent), = seen
    assert n_bytes < 240 * 395 and fragments > 1 and sent == seen[0][0]


@pytest.mark.parametrize("hot", [0, 1])
def test_pairs_of_a_fragment_leave_in_parts(monkeypatch, hot):
    """All pairs of documents that share one n-gram, in batches that don't grow with the pairs; also between two blocks."""
    monkeypatch.setattr(ngram_jaccard, "PAIRS_AT_ONCE", 200)
    n, lead, bits = 500, 3, 2
    u4 = lambda *x: np.array(x, np.uint32)
    blob = lambda k: common.pack(np.array([k]), u4(40 + k % 3), u4(hot), u4(2), common.six(np.array([5, 6], np.uint64)), np.array([k % lead == 0, 1], np.uint8))
    rows = [pa.RecordBatch.from_pydict({"block": pa.array([k % 2 for k in part], pa.int32()), "payload": pa.array([blob(k) for k in part], pa.binary())}) for part in (range(n // 2), range(n // 2, n))]
    for j, want in ((0, n * (n - 1) // 2), (1, n * n // 4)):
        key = tuple(pa.scalar(x) for x in (hot << bits, 0, j))
        parts = list(ngram_jaccard._partial(bits, 0.5)(key, iter(rows)))
        assert max(p.num_rows for p in parts) <= n
        got = pa.Table.from_batches(parts).to_pylist()
        assert len({(r["doc_a"], r["doc_b"]) for r in got}) == len(got) == want
        for r in got:
            a, b = r["doc_a"], r["doc_b"]
            assert a < b and (not j or a % 2 != b % 2) and r["n"] == (0 if hot else 2) + ngram_jaccard.LED
            assert r["sizes"] == (40 + a % 3) << 32 | (40 + b % 3)


def test_ngram_join_sends_python_bounded_batches(spark, monkeypatch):
    """A worker's memory doesn't follow the length of 10,000 rows; the session's own bound is back afterwards."""
    grams, name = ngram_jaccard._grams, "spark.sql.execution.arrow.maxBytesPerBatch"

    def bounded(bits: int, n: int):
        run = grams(bits, n)

        def each(batches):
            for batch in batches:
                assert batch.nbytes < 5 << 20, batch.nbytes
                yield batch

        return lambda batches: run(each(batches))

    monkeypatch.setattr(ngram_jaccard, "_grams", bounded)
    docs = spark.range(0, 400, 1, 1).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 6000), x -> concat('w', (id DIV 2) * 7000 + x))) AS text")
    before = spark.conf.get(name, None)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_jaccard.classes(docs).collect()}
    assert got == {k: (k // 2 * 2, 1) for k in range(400)} and spark.conf.get(name, None) == before


def test_ngram_join_writes_files_by_cores(spark, docs_of, monkeypatch):
    """Tables in the shared folder have no more files than the cores call for, however many partitions a shuffle has."""
    seen, cut = [], ngram_jaccard.cut
    monkeypatch.setattr(ngram_jaccard, "FILES", 1, raising=False)
    monkeypatch.setattr(ngram_jaccard, "cut", lambda df: seen.append((out := cut(df)).rdd.getNumPartitions()) or out)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(before, ("9", "false"), strict=True):
            spark.conf.set(k, v)
        rows = near_rows()[:120]
        assert found_classes(spark, docs_of(rows), rows) == brute_classes(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(seen) > 6 and max(seen) <= spark.sparkContext.defaultParallelism < 9


def test_hot_pairs_meet_in_cells(spark, docs_of, monkeypatch):
    """No task holds all pairs of a group of near copies."""
    monkeypatch.setattr(ngram_jaccard, "HOT_PAIRS", 300)
    counted = ngram_jaccard._add_hot

    def bounded(key: tuple[pa.Scalar, ...], likely: pa.Table, held: pa.Table) -> pa.Table:
        assert likely.num_rows < 1800, likely.num_rows
        return counted(key, likely, held)

    monkeypatch.setattr(ngram_jaccard, "_add_hot", bounded)
    text = [f"w{k}" for k in range(100)]
    rows = [(k, " ".join([*text[:k], "changed", *text[k + 1 :]])) for k in range(90)]
    want = {row: (0, 89) for row in rows}
    assert brute_classes(rows) == want and found_classes(spark, docs_of(rows), rows) == want


def test_ngram_join_of_a_table_loaded_twice(spark, docs_of):
    """Slices with the same rows: partitions that repeat, and a repeated text that is longer than a slice."""
    rng = random.Random(5)
    long = [" ".join(f"{c}{rng.randrange(3000)}" for _ in range(3000)) * 250 for c in "ab"]
    assert min(map(len, long)) > 4 << 20
    rows = near_rows()[:80] + [(800, long[0]), (800, long[0]), (801, long[0] + " the end"), (801, long[0] + " the end"), (802, long[1])]
    docs = docs_of(rows).repartition(3, "doc_id").cache()
    want = brute_classes(rows)
    assert want[800, long[0]] == (800, 1) and found_classes(spark, docs.union(docs).union(docs), rows) == want
    assert found_classes(spark, docs.coalesce(1), rows) == want


def test_ngram_join_of_an_id_with_several_texts(spark, docs_of):
    """Versions don't add up; a clean row of an id in a class stays."""
    w = [f"w{k}" for k in range(60)]
    part = lambda a, b, c: " ".join(w[a:b] + [f"{c}{k}" for k in range(40 - (b - a))])
    whole, clean = " ".join(w[:40]), "a clean version of the second document"
    rows = [(1, whole), (2, part(0, 20, "p")), (2, part(20, 40, "q")), (2, clean), (3, part(0, 36, "r")), (3, part(0, 32, "s")), (3, whole), (4, part(0, 34, "t")), (4, part(0, 30, "u"))]
    want = brute_classes(rows)
    assert found_classes(spark, docs_of(rows), rows) == want and {i for i, _ in want} == {1, 3, 4}
    assert some((r["doc_id"], r["text"]) for r in ngram_jaccard.keep_one(docs_of(rows)).collect()) == some([rows[0], *rows[1:4]])
    assert sorted(r["text"] for r in exact_dedup.deduplicate(docs_of(rows)).filter("doc_id = 3").collect()) == sorted(x for _, x in rows[4:6])


def test_suffix_dedup_in_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 30_000)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = sorted((r["doc_id"], r["start_word"], r["end_word"]) for r in suffix_dedup.repeats(docs).collect())
    assert got == brute_repeats(rows, 50) and got


def test_components(spark):
    chain = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (101, 102), (100, 102), (7, 7)]
    got = {r["doc_id"]: r["group_id"] for r in ngram_jaccard.groups(spark.createDataFrame(chain, "doc_a long, doc_b long")).collect()}
    assert got == {**{k: 1 for k in range(2, 41)}, 101: 100, 102: 100}


# -- decontamination ------------------------------------------------------------
ITEMS = [
    (1, "A train leaves with 40 passengers and travels 120 km to the city. There Alice waits for 15 minutes and then meets Bob who has 40 apples."),
    (2, "the cat sat on a mat while all of the dogs slept near the river"),
    (3, "too short"),
    (4, None),
    (None, "the cat sat on a mat while all of the dogs"),
    (6, "7 + 12 = ? 3 apples cost 4 dollars"),
    (7, "add 3 and 4 please"),
]
PROSE = "nothing of this text has any thing to do with what the tests are made of and so it goes on for a while"


def test_decontamination(spark, docs_of, hard_rows):
    one = ITEMS[0][1]
    swapped = one.replace("Alice", "Mary Ann Carol").replace("120", "300").replace("40", "64")
    broken = one.replace("40 passengers", "41 passengers").replace("Alice", "Eve").replace("40 apples", "42 apples")
    words = ITEMS[1][1].split()
    rows = hard_rows + [(20, f"{PROSE}. {one} {PROSE}"), (21, f"{PROSE}. {swapped}"), (22, f"{broken}"), (23, PROSE), (24, ITEMS[1][1].upper()), (25, " ".join(one.split()[:9])), (26, "The cat sat. 40 km 12 kg Bob Alice 7 miles 9 km Eve 40")]
    rows += [(27, f"{PROSE} {ITEMS[5][1]} {PROSE}"), (28, ITEMS[5][1].replace("7", "8")), (29, f"{PROSE} add 3 and 4 please {PROSE}"), (30, PROSE), (31, " ".join(words[:8] + ["thing"] + words[9:]))]
    rows += [(20, "another text of the same id"), (20, PROSE)]
    items = spark.createDataFrame(ITEMS + ITEMS[:1], "item_id long, text string").selectExpr("*", "1 AS k", "2 AS pos", "item_id AS doc_id", "text AS slots")
    docs = docs_of(rows)
    got = {(r["doc_id"], r["item_id"]): r["reparameterised"] for r in decontamination.contaminated(docs, items).collect()}
    assert got == {(20, 1): False, (21, 1): True, (24, 2): False, (27, 6): False, (29, 7): False}
    kept = decontamination.decontaminate(docs, items)
    assert kept.count() == len(rows) - 5 and kept.columns == docs.columns and kept.filter("doc_id = 20").count() == 2
    for d, b in ((docs.limit(0), items), (docs, items.limit(0))):
        assert decontamination.contaminated(d, b).count() == 0


def test_bloom(spark):
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000)).tolist()
    own = decontamination.Bloom.of(spark.createDataFrame([(k,) for k in keys], "window long"), len(keys))
    assert len(own(np.array(keys, np.uint64))) == len(keys)
    assert len(own(np.random.default_rng(2).integers(0, 2**63, 200_000).astype(np.uint64))) < 1000


def test_decontamination_brute_force(spark):
    """All windows of all documents against all of the benchmark's, in plain Python."""

    def template(text):
        raw, start = [], True
        for w in text.split():
            kind, value, ends = decontamination.kind_of(w)
            if kind != decontamination.DROP:
                literal = kind == decontamination.WORD or (kind == decontamination.CAPITAL and start)
                if raw and not literal and kind == decontamination.CAPITAL == raw[-1][0]:
                    raw[-1] = (kind, f"{raw[-1][1]} {value}")
                else:
                    raw.append(("w", value) if literal else (kind, f"{kind}:{value}"))
            start = ends
        return raw

    def windows(out):
        n = decontamination.W
        return [(p, out[p : p + n]) for p in range(len(out) - n + 1) if sum(k == "w" for k, _ in out[p : p + n]) >= decontamination.LITERAL]

    shape = lambda win: tuple((k, v) if k == "w" else (k,) for k, v in win)
    slots = lambda win: [v for k, v in win if k != "w"]
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    own, size = collections.defaultdict(list), {}
    for r in items.collect():
        whole = template(r["text"])
        wins = windows(whole)
        assert wins  # items without windows are another test's
        size[r["item_id"]] = (len(whole), len(wins))
        for p, win in wins:
            own[shape(win)].append((r["item_id"], p, slots(win)))
    want = {}
    for r in docs.collect():
        lines = collections.defaultdict(list)
        for at, win in windows(template(r["text"])):
            for item, p, s in own.get(shape(win), ()):
                lines[item, at - p].append((p, list(zip(s, slots(win)))))
        found, run = collections.defaultdict(set), collections.Counter()
        for (item, _), hits in lines.items():
            pairs = {x for _, z in hits for x in z}
            if len(pairs) == len({a for a, _ in pairs}):
                ps = {p for p, _ in hits}
                found[item] |= ps
                tokens = {q for p in ps for q in range(p, p + decontamination.W)}
                for q in tokens:
                    n = 0
                    while q + n in tokens:
                        n += 1
                    run[item] = max(run[item], n)
        for item, ps in found.items():
            tokens, wins = size[item]
            covered = len({q for p in ps for q in range(p, p + decontamination.W)})
            if (covered / tokens >= decontamination.SHARE and len(ps) >= min(wins, decontamination.FEWEST)) or run[item] >= decontamination.RUN:
                want[r["doc_id"], item] = (len(ps), covered / tokens)
    got = {(r["doc_id"], r["item_id"]): (r["n_windows"], r["share"]) for r in decontamination.contaminated(docs, items).collect()}
    assert got == want and want


# -- quality --------------------------------------------------------------------
def python_features(text):
    w = re.split(r"\s+", text.strip())
    n, c = len(w), len(text)
    count = lambda rx: len(re.findall(rx, text)) / c
    return [
        np.log1p(c), np.log1p(n), c / n, len(set(w)) / n, count(r"[#$%&*]"), count(r"[@~^<>{}=_+]"), count(r"[|]"), count("!"), sum(x.isupper() for x in text) / c,
        count("[0-9]"), count("[.?]"), count("[,;:]"), count("\n"), sum(a == b for a, b in zip(w, w[1:])) / n,
    ]


def test_quality(spark, docs_of, hard_rows):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels.filter("doc_id % 3 <> 0"))
    assert 5 <= len(model.rules) <= 120
    rows = docs.select("doc_id", "text").collect()
    x = np.array([python_features(r["text"]) for r in rows])
    brute = dict(zip((r["doc_id"] for r in rows), model.score(x)))
    got = {r["doc_id"]: r for r in quality.classify(docs, model).collect()}
    assert {k: v["quality"] for k, v in got.items()} == pytest.approx(brute, abs=1e-6)
    held = {r["doc_id"]: r["quality"] for r in labels.filter("doc_id % 3 = 0").collect()}
    assert np.mean([got[k]["keep"] == bool(v) for k, v in held.items()]) >= 0.97
    assert np.mean([got[k]["keep"] for k, v in held.items() if v == 1]) >= 0.98
    hard = docs_of(hard_rows)
    scored = quality.classify(hard, model)
    assert scored.count() == len(hard_rows) and scored.filter("quality IS NULL").count() == 0
    assert {r["doc_id"] for r in scored.filter("quality = 0").collect()} == {None, 2, 3, 4}
    kept = quality.keep_good(hard, model)
    assert kept.columns == hard.columns and kept.count() == scored.filter("keep").count()
    assert quality.keep_good(hard.limit(0), model).count() == 0


def test_every_row_gets_its_leaf():
    """Rows outside a tree's subsample get the value of the leaf that holds them, like those inside."""
    rng = np.random.default_rng(1)
    x = rng.random((300, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.4) & (x[:, 3] > 0.3)).astype(float)
    edges = [np.linspace(0.1, 0.9, 9)] * x.shape[1]
    binned = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], 1)
    step, rules = np.full(300, np.nan), set()
    step[:] = 0
    rows = np.sort(rng.choice(300, 200, replace=False))
    quality._tree(binned, edges, y - 0.5, np.full(300, 0.25), rows, np.arange(300), (), rules, step)
    leaves = [r for r in rules if not any(set(r.terms) < set(o.terms) for o in rules)]
    assert sum(r.holds(x) for r in leaves).tolist() == [1] * 300
    for r in leaves:
        inside = r.holds(x)
        assert len(set(step[inside].tolist())) == 1 and step[inside][0] != 0
    model = quality.fit(x, y)
    assert np.mean((model.score(x) > 0.5) == (y > 0)) > 0.97


def test_quality_without_labels(spark, docs_of):
    docs = docs_of([(1, "some text"), (2, "")])
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    assert [r["keep"] for r in quality.classify(docs, quality.train(docs, none)).orderBy("doc_id").collect()] == [True, False]
    bad = spark.createDataFrame([(1, 0)], "doc_id long, quality int")
    assert quality.classify(docs, quality.train(docs, bad)).filter("keep").count() == 0


# -- HTML -----------------------------------------------------------------------
def test_blocks():
    page = '<html><body><nav><ul><li><a href="/x">Home</a><li><a>Two</a></ul></nav><!-- <p>no</p> --><script>var t="</p>";</script><p>Some <b>bold</b> text<br>more &amp; more<p class="x y">Next <div>in'
    got = [(b.path[1:], b.text, b.linked) for b in html_extraction.blocks(page)]
    assert got[0] == (("body", "nav", "ul", "li", "a"), "Home", 4) and got[1][1] == "Two" and got[2][1] == "Some bold text more & more"
    assert got[3] == (("body", "p", "x", "y"), "Next", 0) and got[4][1] == "in"
    assert html_extraction.blocks("") == [] and html_extraction.blocks("a < b > c")[0].text == "a < b > c"
    assert len(html_extraction.blocks("<p>x" * 3000)) == 3000 and html_extraction.blocks('<p class="' + "x" * 100_000)


def test_html_extraction(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = [r["html"] for r in pages.orderBy("page_id").collect()]
    net = html_extraction.train(rows[:150])
    held = [html_extraction.blocks(p) for p in rows[150:]]
    truth = [np.array([html_extraction.teacher(b) for b in bs]) for bs in held]
    got = html_extraction.label(net, held, {})
    assert np.mean(np.concatenate(got) == np.concatenate(truth)) >= 0.97
    bare = [html_extraction.blocks(re.sub("</?article>", "", p)) for p in rows[150:]]  # without the teacher's tag
    assert np.mean(np.concatenate(html_extraction.label(net, bare, {})) == np.concatenate(truth)) >= 0.9
    hard = spark.createDataFrame([(1, None), (2, ""), (None, "<p>x"), (3, rows[0]), (3, rows[0]), (4, "<p>some words here. " * 5000), (5, "<<<>>> </p></p>")], "page_id long, html string")
    out = {(r["page_id"], r["text"], r["n_blocks"]) for r in html_extraction.extract(hard, net).collect()}
    assert (1, None, 0) in out and (2, "", 0) in out and len(out) == 6
    assert html_extraction.extract(hard.limit(0), None).count() == 0 and html_extraction.train([]) is None


def plain_lstm(p, xs):
    """The labeller's outputs, block after block in plain Python."""
    sig, n = (lambda v: 1 / (1 + np.exp(-v))), html_extraction.HIDDEN

    def one(d, seq):
        h, s, out = np.zeros(n), np.zeros(n), []
        for x in seq:
            a = np.concatenate([x, h]) @ p["w" + d].astype(float) + p["c" + d]
            i, f, o, g = sig(a[:n]), sig(a[n : 2 * n]), sig(a[2 * n : 3 * n]), np.tanh(a[3 * n :])
            s = f * s + i * g
            h = o * np.tanh(s)
            out.append(h)
        return out

    both = [np.concatenate(x) for x in zip(one("f", xs), one("b", xs[::-1])[::-1])]
    return np.array([float(v @ p["o"] + p["z"][0]) for v in both])


def test_html_brute_force(spark):
    """The registered operator's rows against a plain Python reading of every page: own path vectors, own network."""
    import zlib

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    net = html_extraction.train(html_extraction.sample(pages))
    got = {r["page_id"]: (r["text"], r["n_blocks"], r["n_content"]) for r in QUERIES["op9_html_extraction"](spark, SF).collect()}
    near = 0
    for r in pages.collect():
        found = html_extraction.blocks(r["html"])
        xs = []
        for b in found:
            x, ws = np.zeros(html_extraction.DIM), b.text.lower().split()
            for t in b.path:
                x[zlib.crc32(("<" + t).encode()) % html_extraction.PATH_DIM] += 1
            x[: html_extraction.PATH_DIM] = np.minimum(x[: html_extraction.PATH_DIM], 2)
            for w in ws:
                x[html_extraction.PATH_DIM + zlib.crc32(w.encode()) % html_extraction.WORD_DIM] += 1 / len(ws)
            x[-4:] = (np.log1p(len(b.text)) / 4, np.log1p(len(ws)) / 4, min(1.0, b.linked / len(b.text)), b.text[-1] in ".!?…")
            xs.append(x)
        z = plain_lstm(net.p, xs) if xs else np.zeros(0)
        if len(z) and np.abs(z).min() < 1e-3:  # single precision may decide such a block otherwise
            near += 1
            continue
        good = z > 0
        assert got[r["page_id"]] == ("\n".join(b.text for b, ok in zip(found, good) if ok), len(found), int(good.sum()))
    assert len(got) == pages.count() and near < 0.05 * len(got)


def test_deep_markup(spark):
    deep = "<div>word " * 20_000 + "</p>" * 20_000
    found = html_extraction.blocks(deep)
    assert len(found) == 20_000 and len(found[-1].path) == 20_000 and html_extraction.vectors(found, {}).shape == (20_000, html_extraction.DIM)


def test_lstm_gradients():
    rng = np.random.default_rng(0)
    net = html_extraction.BiLSTM.fresh(rng)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, mask = html_extraction.padded([rng.standard_normal((5, html_extraction.DIM)), rng.standard_normal((3, html_extraction.DIM))])
    y = (rng.random(mask.shape) > 0.5).astype(float)
    _, grads = net.loss_and_gradients(x, y, mask)
    for k, p in net.p.items():
        at = np.unravel_index(int(rng.integers(p.size)), p.shape)
        old, e = p[at], 1e-3
        p[at] = old + e
        up = net.loss_and_gradients(x, y, mask)[0]
        p[at] = old - e
        down = net.loss_and_gradients(x, y, mask)[0]
        p[at] = old
        assert grads[k][at] == pytest.approx((up - down) / (2 * e), abs=2e-4)


# -- all queries ----------------------------------------------------------------
def test_registered_queries(spark):
    """The queries without SQL run over whole tables: a row for each document."""
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    enc = bpe.encoding(bpe.VOCABULARY, bpe.PATTERN)
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    tokens = {r["doc_id"]: r["tokens"] for r in QUERIES["op6_bpe"](spark, SF).collect()}
    assert tokens == {i: enc.encode_ordinary(t) for i, t in texts.items()} and any(len(t) >= bpe.LONG for t in texts.values())
    assert {r["doc_id"]: r["n_tokens"] for r in QUERIES["op10_token_counts"](spark, SF).collect()} == {i: len(t) for i, t in tokens.items()}
    assert QUERIES["op7_quality"](spark, SF).count() == n and QUERIES["op2_decontamination"](spark, SF).count() > 0


@pytest.mark.parametrize("bound", [0, 1 << 30])
def test_either_side_of_the_bounds(spark, monkeypatch, bound):
    """Tables too large to broadcast are joined by a shuffle, with the same rows."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", bound)
    monkeypatch.setattr(suffix_dedup, "BROADCAST_BYTES", bound)
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", bound)
    for name in ("op1_suffix_dedup", "op4_exact_dedup", "op5_line_dedup"):
        same(spark, SF, QUERIES[name], ORACLE_SQL[name])


def test_other_columns(spark):
    """Columns of any name stand beside those that operators use."""
    names = ["k", "id", "sig", "doc", "digest", "sha", "shard", "bucket", "payload", "window", "pos", "slots", "__id", "__k", "__row", "t", "w", "n", "item_id", "drops", "rows", "class_id"]
    extra = lambda t: spark.read.parquet(f"{SF}/{t}.parquet").selectExpr("*", *(f"{k} AS `{c}`" for k, c in enumerate(names) if c != "item_id" or t != "benchmark"))
    plain = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    rows = lambda df: sorted(map(str, df.collect()))
    model = quality.train(plain("documents"), plain("labels"))
    assert quality.train(extra("documents"), extra("labels")).rules == model.rules
    for run in (
        lambda d, b: quality.keep_good(d, model), lambda d, b: exact_dedup.deduplicate(d), lambda d, b: ngram_jaccard.keep_one(d), decontamination.decontaminate,
    ):
        out = run(extra("documents"), extra("benchmark"))
        assert out.columns == extra("documents").columns
        assert rows(out.select("doc_id", "text")) == rows(run(plain("documents"), plain("benchmark")).select("doc_id", "text"))
    for run in (suffix_dedup.repeats, line_dedup.dedup_lines, bpe.encode, token_counts.token_counts, sharding.shard):
        assert rows(run(extra("documents"))) == rows(run(plain("documents")))
    assert html_extraction.extract(extra("pages"), None).count() == plain("pages").count()


# -- the pipeline ---------------------------------------------------------------
def test_pipeline(spark):
    import corpus_pipeline as c

    docs, names = spark.read.parquet(f"{SF}/documents.parquet"), None
    kept = docs
    for k, (_, stage) in enumerate(c.STAGES):
        out = stage(spark, kept, SF)
        if k < len(c.STAGES) - 1:
            assert out.columns == docs.columns
            before, after = {r["doc_id"] for r in kept.collect()}, {r["doc_id"] for r in out.collect()}
            rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
            assert after <= before
            if k == 1:
                assert len(after) == len({t for _, t in rows})
            if k == 2:
                assert after == {i for i, _ in kept_rows(rows, brute_classes(rows))}
            if k == 3:
                items = spark.read.parquet(f"{SF}/benchmark.parquet")
                flagged = {i for i, t in rows for r in items.collect() if " ".join(r["text"].split()) in " ".join(t.split())}
                assert flagged <= before - after
        kept, names = out, out.columns
    assert names == ["doc_id", "tokens", "n_tokens", "round_trip"]
    run = c.run(spark, SF)
    assert sorted(r["doc_id"] for r in run.collect()) == sorted(r["doc_id"] for r in kept.collect()) and run.filter(~F.col("round_trip")).count() == 0


def test_pipeline_of_hard_rows(spark, docs_of, hard_rows, tmp_path):
    """Nulls, empty and long texts, repeats, one id with two texts, and empty tables go through every stage."""
    import corpus_pipeline as c

    rows = hard_rows + [(5, "a text of its own with some more words so that it is no copy of any other document here. It ends well, too.")]
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{table}.parquet").write.parquet(str(tmp_path / f"{table}.parquet"))
    for frame in (docs_of(rows).select(*names), docs_of(rows).select(*names).limit(0)):
        kept = frame
        for k, (_, stage) in enumerate(c.STAGES):
            kept = stage(spark, kept, str(tmp_path))
            assert k == len(c.STAGES) - 1 or kept.columns == names
        frame.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        assert c.run(spark, str(tmp_path)).count() == kept.count()
