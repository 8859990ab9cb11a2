"""The operators' SQL gives the queries' rows."""

import duckdb

from plumbline.llm import queries


def test_same_rows_as_sql(spark, sf):
    con = duckdb.connect()
    for name in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, sf)
        want = con.execute(sql)
        at = [got.columns.index(d[0]) for d in want.description]
        assert sorted((tuple(r[i] for i in at) for r in got.collect()), key=repr) == sorted(want.fetchall(), key=repr), name
