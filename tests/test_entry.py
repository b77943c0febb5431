import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    return round(value, 8) if isinstance(value, float) else tuple(value) if isinstance(value, list) else value


@pytest.mark.parametrize("name", [n for n in sorted(entry.oracle_sql()) if n not in ("minhash_signature",)])
def test_query_matches_sql(spark, tables, name):
    frame = entry.queries()[name](spark, FOLDER)
    columns = sorted(frame.columns)
    result = tables.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in result.fetchall())
    assert sorted(repr([plain(x) for x in r]) for r in frame.select(*columns).collect()) == want


def test_flagship(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["first", "second", "status"] and frame.count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
