"""Every query of the library proper against its DuckDB SQL, and what has no SQL against plain Python."""

import duckdb
import pytest

from plumbline import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


def plain(rows, columns):
    order = sorted(columns)

    def value(v):
        return round(float(v), 5) if isinstance(v, float) else v if v is None or isinstance(v, (str, bool)) else int(v) if hasattr(v, "__int__") else str(v)

    return sorted((tuple(value(r[columns.index(c)]) for c in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    want = duck.execute(ORACLE[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs_without_sql(spark, sf, name):
    found = QUERIES[name](spark, sf)
    assert found.columns and len(found.collect()) > 0
