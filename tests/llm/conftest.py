import pytest


@pytest.fixture()
def docs_of(spark):
    """Documents with columns whose names might clash with those that operators use inside."""

    def make(rows):
        rows = [(i, t, "en", f"s{k % 3}", len(t or ""), k, "x", k) for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, k long, shard string, bucket long")

    return make


@pytest.fixture()
def hard_rows():
    """Null ids and texts, empty and blank texts, ties, repeated rows, one very long text."""
    text = "one two three four five six seven eight nine ten " * 8
    return [(1, text), (1, text), (2, None), (None, text), (None, None), (3, ""), (4, "   \n\t "), (5, text), (6, "a"), (7, "word " * 40_000), (8, "x" * 50_000), (9, "Ünï çødé 漢字 🙂\n\nline")]
