"""Compare a Spark query with its SQL in DuckDB, as sets of rows."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        frame[c] = frame[c].map(lambda v: round(v, 6) if isinstance(v, float) else str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else v)
    return frame.astype(str).sort_values(list(frame.columns)).reset_index(drop=True)


def same(spark, sf, run, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    mine, theirs = run(spark, sf).toPandas(), con.sql(sql).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    a, b = normal(mine), normal(theirs)
    assert a.equals(b), a.merge(b, how="outer", indicator=True).query("_merge != 'both'").head(10).to_string()
