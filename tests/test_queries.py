import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import pytest

from oracle import same
from quern.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    same(spark, SF, QUERIES[name], SQL[name])


def test_frequencies_add_up_over_rows_of_one_id(spark, tmp_path):
    rows = [(1, "red fox fox"), (1, "fox a b"), (1, "fox"), (None, "x y"), (None, "y z"), (2, None), (3, "")]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' lang", "'src1' source", "1L n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["doc_id"] or 0, r["word"], r["tf"]) for r in QUERIES["tf_table"](spark, str(tmp_path)).collect())
    third = round(1 / 3, 9)
    assert got == [(0, "x", 0.5), (0, "y", 1.0), (0, "z", 0.5), (1, "a", third), (1, "b", third), (1, "fox", 1.0), (1, "fox", 1.0), (1, "red", third)]
    assert "Aggregate" not in QUERIES["tf_table"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).columns
