import math
import re

import pytest
from pyspark.sql import functions as F

from quern.collection import Collection
from quern.errors import DocumentNotFoundError, DocumentValidationError, QueryError, SchemaValidationError
from quern.functions import geo, highlight
from quern.functions.stemming import STEMMERS, stem_english
from quern.functions.text import LANGUAGES, Tokenizer, bounded_levenshtein, replace_diacritics_py, sort_key, stop_words
from quern.operators import filters as f
from quern.plans import index, rank
from quern.schema import Schema
from quern.types import BM25Params, FacetConfig, GeoPoint, GroupBy, NumberFacetRange, SortBy, SortOrder


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def ids(result):
    return [r["id"] for r in result.hits.collect()]


@pytest.fixture(scope="module")
def books(spark):
    c = Collection.create(spark, {"title": "string", "body": "string", "price": "number", "tags": "string[]", "kind": "enum", "marks": "enum[]", "sold": "boolean", "meta": {"rating": "number"}})
    return c.insert([
        {"id": "a", "title": "Red fox", "body": "A quick red fox. It jumps!", "price": 10, "tags": ["x", "y"], "kind": "one", "marks": ["p", "q"], "sold": True, "meta": {"rating": 4.5}},
        {"id": "b", "title": "Blue whale", "body": "The whale is large", "price": 20.5, "tags": ["y"], "kind": "two", "sold": False},
        {"id": "c", "title": "Foxes", "body": None, "kind": "one", "meta": {"rating": 2}},
        {"title": "Red red whale fox", "price": 5},
    ])


def test_bm25_constants(spark):
    v = lambda tf, n, length: one(spark, rank.bm25(F.lit(tf), F.lit(n), 10, F.lit(length), 5.0, BM25Params()))
    assert v(0.0, 1, 5) == pytest.approx(0.8301792352875859, abs=1e-10)
    assert v(0.25, 2, 8) == pytest.approx(0.7821, abs=1e-3)


def test_pt15_positions(spark):
    for n, total, want in ((14, 30, 7), (29, 30, 14), (50, 100, 7), (13, 14, 13)):
        assert one(spark, index.position(F.lit(n), F.lit(total))) == want


def test_running_average_with_missing(spark):
    lengths = [3, None, 5, None, None, 2, 7, None]
    c = Collection.create(spark, {"t": "string"}, allow_duplicates=True).insert([{"t": None if n is None else "w " * n} for n in lengths])
    avg = 0.0
    for i, n in enumerate(lengths, 1):
        if n is not None:
            avg = (avg * (i - 1) + n) / i
    assert index.length_stats(c.docs, ["t"], c.tokenizer).average["t"] == pytest.approx(avg, abs=1e-9)


def test_tokenizer(spark):
    assert Tokenizer().tokenize(spark, "The quick-brown FOX, the naïve café") == ["the", "quick-brown", "fox", "na", "ve", "cafe"]
    assert Tokenizer(use_default_stop_words=True).tokenize(spark, "the fox") == ["fox"]
    assert Tokenizer(words=("fox",)).tokenize(spark, "the fox") == ["the"]
    assert Tokenizer(skip={"t"}).tokenize(spark, "Two Words", "t") == ["Two Words"]
    assert Tokenizer(stemming=True).tokenize(spark, "running runs") == ["run"]
    assert Tokenizer(custom=lambda c: F.split(c, "x")).tokenize(spark, "axb") == ["a", "b"]
    with pytest.raises(ValueError):
        Tokenizer("klingon")
    with pytest.raises(ValueError):
        Tokenizer("de", custom=lambda c: c)
    assert len(LANGUAGES) == 30
    for lang in LANGUAGES:
        assert Tokenizer(lang).tokenize(spark, "abc 12") == ["abc", "12"]
    assert len(stop_words("german")) == 231 and stop_words("czech") == frozenset() and len(stop_words("chinese")) == 794
    assert replace_diacritics_py("Łódź × ÷ ß") == "Lodz × ÷ s"


def test_tokenizers_agree(spark):
    """The driver's tokenizer and the column give the same tokens."""
    texts = ["", "  ", "The Quick-brown fox's naïve Café_au lait 12,5", "Straße ÄÖÜ über", "Ёлка і їжак Привет", "Ελλάδα ώρα", "Łódź ŞIŞLI ığüş", "the the The", "नेपाली भाषा تجربة"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    kinds = [Tokenizer(x) for x in LANGUAGES] + [Tokenizer(use_default_stop_words=True, stemming=True), Tokenizer(allow_duplicates=True), Tokenizer("de", words=("über",))]
    rows = df.select("k", "t", *(t.column(F.col("t")).alias(f"c{n}") for n, t in enumerate(kinds))).collect()
    for r in rows:
        for n, t in enumerate(kinds):
            assert t.tokenize(spark, r["t"]) == r[f"c{n}"], (t.language, r["t"])


def test_stemmer_samples():
    want = {"consign": "consign", "consigned": "consign", "consisting": "consist", "knightly": "knight", "generously": "generous", "hopping": "hop", "hoping": "hope", "skies": "sky", "national": "nation", "relational": "relat", "happiness": "happi", "caresses": "caress"}
    assert {w: stem_english(w) for w in want} == want


def test_stemmers_of_other_languages(spark):
    samples = {
        "german": {"aufeinander": "aufeinand", "aufenthalt": "aufenthalt", "kategorien": "kategori", "kategorischen": "kategor", "häuser": "haus", "schönheit": "schonheit"},
        "swedish": {"jaktkarlarne": "jaktkarl", "klostergården": "klostergård", "jämförelse": "jämför", "friskt": "frisk"},
        "danish": {"undersøgelse": "undersøg", "indtage": "indtag", "undgik": "undgik", "uundgåelig": "uundgå"},
        "norwegian": {"havnedistriktene": "havnedistrikt", "havneavgifter": "havneavgift", "opning": "opning"},
        "spanish": {"chicas": "chic", "torneado": "torn", "cheques": "chequ", "chilena": "chilen", "rápidamente": "rapid", "tortura": "tortur"},
    }
    for language, words in samples.items():
        assert {w: STEMMERS[language](w) for w in words} == words
    assert Tokenizer("de", stemming=True).tokenize(spark, "Kategorien Häuser") == ["kategori", "haus"]


def test_fuzzy(spark):
    d = lambda a, b, k: one(spark, bounded_levenshtein(F.lit(a), F.lit(b), k))
    assert d("kitten", "sitting", 3) == 3 and d("kitten", "sitting", 2) is None and d("foo", "foobar", 1) == 0


def test_sort_keys(spark):
    order = lambda lang, xs: [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x string").orderBy(sort_key(F.col("x"), lang)).collect()]
    assert order("norwegian", "åaøoæ") == list("aoæøå")
    assert order("swedish", "öaäåo") == list("aoåäö")


def test_schema():
    s = Schema({"a": "string", "m": {"b": "number", "c": "geopoint"}})
    assert s.paths == ["a", "m.b", "m.c"]
    assert Schema.from_json(s.to_json()).fields == s.fields
    for bad in ({}, {"m": {}}, {"a": "thing"}):
        with pytest.raises(SchemaValidationError):
            Schema(bad)
    for path in ("m", "x", "a.b"):
        with pytest.raises(SchemaValidationError):
            s.type_at(path)


def test_search(books):
    assert ids(books.search("fox"))[0] in ("a", "c", "0") and books.search("fox").total() == 3
    assert set(ids(books.search("red fox", threshold=0))) == {"a", "0"}
    assert ids(books.search("whale", properties=["body"])) == ["b"]
    assert set(ids(books.search("fox", exact=True))) == {"a", "0"}
    assert ids(books.search("Blue", exact=True)) == ["b"] and ids(books.search("blue", exact=True)) == []
    assert ids(books.search("whael", tolerance=2)) != []
    assert len(ids(books.search("", limit=10))) == 4
    assert ids(books.search("?!")) == []
    assert ids(books.search(sort_by=SortBy("price"))) == ["0", "a", "b", "c"]
    assert ids(books.search(sort_by=SortBy("price", SortOrder.DESC), limit=2, offset=1)) == ["a", "0"]
    for options in ({"properties": ["price"]}, {"sort_by": SortBy("kind")}, {"boost": {"title": 0}}, {"where": {"nope": f.eq(1)}}, {"where": {"sold": f.gt(1)}}, {"facets": {"nope": FacetConfig()}}, {"group_by": GroupBy(("kind",))}):
        with pytest.raises(QueryError):
            books.search("fox", **options)


def test_algorithms(books):
    for name in ("qps", "pt15"):
        other = books.reindex(name)
        assert set(ids(other.search("fox"))) == {"a", "c", "0"}
        kept = other.indexed(persist=False)
        assert ids(kept.search("fox")) == ids(other.search("fox"))
    with pytest.raises(QueryError):
        books.reindex("pt15").search("fox", exact=True)
    with pytest.raises(QueryError):
        books.reindex("pt15").search("fox", where={"title": f.eq("fox")})


def test_where(books):
    hit = lambda w, **k: {r["id"] for r in books.docs.filter(books.where(w)).select("id").collect()}
    assert hit({"price": f.between(5, 10)}) == {"a", "0"}
    assert hit({"kind": f.nin(["one"])}) == {"b"}
    assert hit(f.not_({"sold": f.eq(True)})) == {"b", "c", "0"}
    assert hit({"marks": f.contains_all(["p"])}) == {"a"} and hit({"marks": f.contains_any([])}) == set()
    assert hit({"tags": f.eq("y")}) == {"a", "b"} and hit({"meta.rating": f.gt(3)}) == {"a"}
    assert hit({**f.or_({"kind": f.eq("two")}, {"sold": f.eq(True)}), "price": f.lt(15)}) == {"a"}
    assert hit(f.and_()) == set() and hit({}) == {"a", "b", "c", "0"}


def test_facets_and_groups(books):
    wanted = {"kind": FacetConfig(), "price": FacetConfig(ranges=(NumberFacetRange(0, 10), NumberFacetRange(10, 30))), "tags": FacetConfig(), "title": FacetConfig(offset=1, limit=3)}
    r = books.search("", facets=wanted, group_by=GroupBy(("sold",), limit=5))
    values = lambda p: {x["value"]: x["count"] for x in r.facets[p].values.collect()}
    assert values("kind") == {"one": 2, "two": 1} and values("price") == {"0-10": 2, "10-30": 2} and values("tags") == {"x": 1, "y": 2}
    assert len(values("title")) == 2 and r.facets["title"].count.first()[0] == 4
    assert {(g["sold"], g["id"]) for g in r.groups.collect()} == {(True, "a"), (False, "b")}


def test_changes(spark, books):
    with pytest.raises(DocumentValidationError):
        books.insert([{"id": "a"}])
    with pytest.raises(DocumentValidationError):
        books.insert([{"price": "ten"}])
    with pytest.raises(DocumentValidationError):
        books.insert(spark.createDataFrame([(1,)], "title int"))
    with pytest.raises(DocumentNotFoundError):
        books.patch("zz", {"price": 1})
    p = books.patch("a", {"price": None, "meta": {"rating": 1.0}})
    row = p.get("a").first()
    assert row["price"] is None and row["meta"]["rating"] == 1.0 and row["title"] == "Red fox" and p.count() == 4
    u = books.update(["a", "nope"], [{"id": "n", "title": "new"}])
    assert {r["id"] for r in u.docs.collect()} == {"b", "c", "0", "n"}
    gone = spark.createDataFrame([("a",), ("zz",)], "id string")
    assert books.removed_count(gone) == 1 and books.remove_all(gone).count() == 3
    empty = books.clear()
    assert empty.is_empty() and [r["id"] for r in empty.insert([{"title": "x"}]).docs.collect()] == ["1"]
    assert ids(empty.search("fox")) == []


def test_geo(spark):
    ny, la = (40.7128, -74.0060), (34.0522, -118.2437)
    for fn in (geo.haversine, geo.vincenty):
        assert abs(one(spark, fn(F.lit(ny[0]), F.lit(ny[1]), *la)) - 3_944_000) < 40_000
    assert geo.vincenty_array(1, 2, 1, 2) == 0 and math.isnan(geo.vincenty_array(0, 0, 0.5, 179.7)[()])
    square = [GeoPoint(0, 0), GeoPoint(0, 2), GeoPoint(2, 2), GeoPoint(2, 0)]
    assert geo.centroid(square) == GeoPoint(1, 1) and math.isnan(geo.centroid([GeoPoint(0, 0), GeoPoint(1, 1)]).lat)
    c = Collection.create(spark, {"name": "string", "at": "geopoint"}).insert([{"id": "ny", "at": GeoPoint(*ny)}, {"id": "la", "at": {"lat": la[0], "lon": la[1]}}, {"id": "none"}])
    r = c.search(where={"at": f.geo_radius(40, -74, 5000, unit="km")})
    assert ids(r) == ["ny", "la"] and r.hits.filter("id = 'la'").first()["score"] == pytest.approx(1)
    assert ids(c.search(where={"at": f.geo_radius(40, -74, 100, unit="km", inside=False, high_precision=True)})) == ["la"]


def test_highlight(spark):
    df = spark.createDataFrame([("ababa Caña",), ("",), (None,)], "t string")
    for fn in (lambda q, **k: highlight.positions(F.col("t"), q, **k),):
        got = [r[0] for r in df.select(fn("aba caña")).collect()]
        assert [(p["start"], p["end"], p["token"]) for p in got[0]] == [(0, 3, "aba"), (2, 5, "aba"), (6, 10, "Caña")] and got[1] == [] and got[2] is None
        assert [len(r[0] or []) for r in df.select(fn("aba", whole_words=True)).collect()] == [0, 0, 0]
        assert [len(r[0] or []) for r in df.select(fn("ababa", whole_words=True)).collect()] == [1, 0, 0]
    m = highlight.positions(F.col("t"), "aba caña")
    assert df.select(highlight.marked(F.col("t"), m)).first()[0] == "<mark>ababa</mark> <mark>Caña</mark>"
    text = spark.createDataFrame([("x" * 50 + "fox" + "y" * 50,)], "t string")
    assert text.select(highlight.excerpt(F.col("t"), highlight.positions(F.col("t"), "fox"), 9)).first()[0] == "...xxxfoxyyy..."


def test_many_tokens(spark):
    """Threshold 0 holds beyond the 63 tokens of one mask."""
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(150)]
    c = Collection.create(spark, {"t": "string"}).insert([{"id": "all", "t": " ".join(words)}, {"id": "less", "t": " ".join(words[:-1])}, {"id": "mid", "t": " ".join(words[:70] + words[75:])}])
    for kept in (c, c.indexed()):
        assert ids(kept.search(" ".join(words), threshold=0)) == ["all"] and len(ids(kept.search(" ".join(words[:70]), threshold=0))) == 3


def test_cold_search_reads_once(spark):
    """A search without an index tokenizes its documents in one plan, and agrees with one that has it."""
    rows = [{"id": str(k), "t": f"red fox {k} blue. Blue fox, red.", "u": "fox" if k % 3 else None, "tags": ["red", "fox fox"]} for k in range(40)]
    for algorithm in ("bm25", "qps", "pt15"):
        c = Collection.create(spark, {"t": "string", "u": "string", "tags": "string[]"}, algorithm=algorithm, search_arrays=True).insert(rows)
        got, want = ([(r["id"], round(r["score"], 9)) for r in x.search("fox re", limit=50).hits.collect()] for x in (c, c.indexed()))
        assert got == want and len(got) == 40
    c = Collection.create(spark, {"t": "string"}).insert([{"id": "a", "t": "fox"}])
    assert c.search("fox").hits._jdf.queryExecution().analyzed().toString().count("array_distinct") <= 2


def test_words_are_counted_within_the_row(spark):
    rows = [{"id": "a", "t": "fox red fox. red fox", "tags": ["whale fox", "fox"]}, {"id": "b", "t": None, "tags": None}, {"id": "c", "t": " .. ", "tags": []}]
    for algorithm in ("bm25", "qps"):
        c = Collection.create(spark, {"t": "string", "tags": "string[]"}, algorithm=algorithm, search_arrays=True, allow_duplicates=True).insert(rows)
        frame = c.postings(["t", "tags"])
        assert "Aggregate" not in frame._jdf.queryExecution().optimizedPlan().toString()
        value = lambda r: round(r["tf"] * r["n_tokens"]) if algorithm == "bm25" else (r["occ"], r["mask"])
        got = {(r["prop"], r["word"], r["n_tokens"], value(r)) for r in frame.collect()}
        if algorithm == "bm25":
            assert got == {("t", "fox", 5, 3), ("t", "red", 5, 2), ("tags", "fox", 3, 2), ("tags", "whale", 3, 1)}
        else:
            assert got == {("t", "fox", 5, (3, 3)), ("t", "red", 5, (2, 3)), ("tags", "fox", 3, (2, 1)), ("tags", "whale", 3, (1, 1))}


def test_text_is_split_once_for_postings(spark):
    plan = Collection.create(spark, {"t": "string"}).insert([{"t": "red fox"}]).postings(["t"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_threshold_zero_with_many_tokens_explodes_whole_documents_only(spark):
    tokens = [a + b for a in "bcdfghjkl" for b in "aeiou"] + ["xyz", "q"]
    full = " ".join(f"{t}{k}" for t in tokens for k in "12")
    rows = [{"id": "all", "t": full, "u": "ba"}, {"id": "part", "t": full.replace("xyz", "z"), "u": "xyz1"}, {"id": "u", "t": None, "u": " ".join(tokens)}, {"id": "n", "t": "", "u": None}]
    c = Collection.create(spark, {"t": "string", "u": "string"}).insert(rows)
    for options in ({}, {"exact": True}):
        got, want = ({r["doc_ord"]: round(r["score"], 9) for r in x.ranked(" ".join(tokens), threshold=0, **options).collect()} for x in (c, c.indexed()))
        assert got == want != {}
    plan = c.ranked(" ".join(tokens), threshold=0).select("doc_ord")._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"\bJoin (Inner|LeftOuter)", plan)
