"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import os

import duckdb
import pytest

from veilgraph import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def rows(found):
    return sorted(tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in found)


def same(spark, duck, run, sql, folder=FOLDER):
    df = run(spark, folder)
    names = sorted(df.columns)
    want = duck.sql(sql)
    assert sorted(want.columns) == names
    places = [want.columns.index(c) for c in names]
    assert rows(tuple(r) for r in df.select(*names).collect()) == rows(tuple(r[i] for i in places) for r in want.fetchall())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    same(spark, duck, catalog.QUERIES[name], catalog.SQL[name])


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
def test_queries_without_sql(spark):
    for name in sorted(set(catalog.QUERIES) - set(catalog.SQL)):
        assert catalog.QUERIES[name](spark, FOLDER).count() > 0


def test_entry_has_all():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
