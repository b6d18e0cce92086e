import json

import pytest
from pyspark.sql import functions as F

from quern.collection import Collection
from quern.errors import SerializationError, StorageError
from quern.functions.text import Tokenizer
from quern.sources import files, snapshots
from quern.streaming import incremental

DOCS = [{"id": "a", "title": "Red fox", "n": 1}, {"id": "b", "title": "Blue fox whale", "n": 2}, {"title": "Green", "n": 3}]


@pytest.fixture()
def small(spark):
    return Collection.create(spark, {"title": "string", "n": "number"}, stemming=True).insert(DOCS)


@pytest.mark.parametrize("format", ["parquet", "json"])
@pytest.mark.parametrize("tables", [True, False])
def test_round_trip(spark, small, tmp_path, format, tables):
    snapshots.save(small, str(tmp_path / "s"), format, tables)
    back = snapshots.load(spark, str(tmp_path / "s"))
    hits = lambda c: [(r["id"], round(r["score"], 9), r["n"]) for r in c.search("foxes").hits.collect()]
    assert hits(back) == hits(small) != [] and back.next_ord == 4 and (back.tables is not None) == tables
    assert {r["id"] for r in back.insert([{"title": "x"}]).docs.collect()} == {"a", "b", "0", "1"}


@pytest.mark.parametrize("repeats", [True, False])
def test_save_splits_texts_once(spark, tmp_path, monkeypatch, repeats):
    rows = [{"id": str(k), "t": f"fox fox w{k % 7}", "u": f"fox b{k}"} for k in range(40)]
    c = Collection.create(spark, {"t": "string", "u": "string"}, allow_duplicates=repeats).insert(rows)
    want = c.indexed(persist=False).tables
    gaps = Collection.create(spark, {"t": "string", "u": "string"}).insert([*rows, {"id": "x", "t": "fox"}])
    average = gaps.indexed(persist=False).tables.stats.average
    snapshots.save(gaps, str(tmp_path / "gaps"))
    assert snapshots.load(spark, str(tmp_path / "gaps")).tables.stats.average == pytest.approx(average)
    monkeypatch.setattr(snapshots.index, "length_stats", None)
    snapshots.save(c, str(tmp_path / "s"))
    back = snapshots.load(spark, str(tmp_path / "s")).tables
    table = lambda df: sorted(tuple(r) for r in df.select("prop", "word", "df").collect())
    assert back.stats == want.stats and table(back.vocab) == table(want.vocab)
    for at in tmp_path.glob("s/postings/*/*.parquet"):
        words = [r["word"] for r in spark.read.parquet(str(at)).select("word").collect()]
        assert words == sorted(words)


def test_bad_snapshots(spark, small, tmp_path):
    with pytest.raises(StorageError):
        snapshots.load(spark, str(tmp_path / "none"))
    good = snapshots.manifest(small, snapshots.Format.JSON, False, None)
    for change in ({"formatVersion": 2}, {"formatVersion": "1"}, {"schema": None}, {"algorithm": 3}):
        with pytest.raises(SerializationError):
            snapshots.check_manifest(good | change)
    with pytest.raises(SerializationError):
        snapshots.check_manifest([])
    custom = Collection.create(spark, {"t": "string"}, tokenizer=Tokenizer(custom=lambda c: F.split(c, " ")))
    with pytest.raises(SerializationError):
        snapshots.manifest(custom, snapshots.Format.JSON, False, None)
    with pytest.raises(ValueError):
        custom.reindex("qps")


def test_markdown(spark, tmp_path):
    (tmp_path / "guide").mkdir()
    (tmp_path / "guide" / "first-steps.md").write_text("# Getting Started\n\nSome *text* here.\n")
    (tmp_path / "read_me.md").write_text("no heading\n")
    (tmp_path / "skip.txt").write_text("x")
    rows = {r["url"]: r for r in files.markdown_records(files.markdown_folder(spark, str(tmp_path)), {"guide/": "rule"}).collect()}
    assert set(rows) == {"/guide/first-steps", "/read_me"}
    assert (rows["/guide/first-steps"]["title"], rows["/guide/first-steps"]["content"], rows["/guide/first-steps"]["type"]) == ("Getting Started", "Some *text* here.", "rule")
    assert rows["/read_me"]["title"] == "Read Me" and rows["/read_me"]["group"] == "root"


def test_fixture_and_adapter(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps([{"url": "/a", "title": "T"}, {"url": "/b", "title": "U"}]))
    rows = files.fixture(spark, str(tmp_path / "f.json"), "url string, title string")
    twice = files.adapt(rows, lambda r: [{"url": r["url"], "k": k} for k in range(2)], "url string, k int")
    assert rows.count() == 2 and twice.count() == 4 and files.duplicates(twice).count() == 2
    for bad in ("{}", "[1]", '[{"name": "x", "term": "y"}]', '[{"name": "x", "term": "y", "expectEmpty": true, "whereField": "z"}]', "["):
        with pytest.raises(SerializationError):
            files.expectations(bad)
    assert files.expectations('[{"name": "x", "term": "y", "expectEmpty": true}]')
    c = Collection.create(spark, {"title": "string", "content": "string"}).insert([{"title": "b"}, {"title": "A"}])
    assert [r["title"] for r in files.browse_or_search(c, " ").hits.collect()] == ["A", "b"]


def test_stream(spark, tmp_path):
    template = Collection.create(spark, {"title": "string"})
    source = tmp_path / "in"
    source.mkdir()
    kind = "id string, title string, deleted boolean"
    q = incremental.start(template, spark.readStream.schema(kind).json(str(source)), str(tmp_path / "out"), str(tmp_path / "cp"))
    try:
        for k, rows in enumerate(([("a", "red fox", False), ("b", "fox", False)], [("a", "blue whale", False)], [("b", None, True), ("c", "fox cub", False)])):
            (source / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("id", "title", "deleted"), r))) for r in rows))
            q.processAllAvailable()
    finally:
        q.stop()
    c = incremental.read(spark, template, str(tmp_path / "out"))
    assert [r["id"] for r in c.search("fox").hits.collect()] == ["c"] and [r["id"] for r in c.search("whale").hits.collect()] == ["a"] and c.count() == 2


def test_stream_of_arrays(spark, tmp_path):
    template = Collection.create(spark, {"tags": "string[]"}, search_arrays=True)
    rows = spark.createDataFrame([("a", ["red fox", "cub"], False), ("b", ["whale"], False)], "id string, tags array<string>, deleted boolean")
    incremental.write_batch(template, rows, 0, str(tmp_path / "out"))
    incremental.write_batch(template, rows.limit(0), 1, str(tmp_path / "out"))
    assert [r["id"] for r in incremental.read(spark, template, str(tmp_path / "out")).search("fox").hits.collect()] == ["a"]


def test_shared_folder(spark):
    assert snapshots.shared_folder(spark).rsplit("/", 1)[0] == spark.sparkContext.getCheckpointDir()
