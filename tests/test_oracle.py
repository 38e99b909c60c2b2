"""Every registered query against its SQL twin on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_points

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}

QUERIES = entry_points.queries()
ORACLE = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def clean(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def sortable(row):
    return tuple((v is None, str(v)) for v in row)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, tables):
    df = QUERIES[name](spark, SF_DIR)
    order = sorted(df.columns)
    got = sorted((tuple(clean(r[c]) for c in order) for r in df.collect()), key=sortable)
    if name not in ORACLE:
        assert got
        return
    result = tables.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == order
    kinds = dict(df.dtypes)
    assert {d[0]: str(d[1]) for d in result.description} == {c: TYPES[kinds[c]] for c in order}
    places = [names.index(c) for c in order]
    expected = sorted((tuple(clean(r[i]) for i in places) for r in result.fetchall()), key=sortable)
    assert got == expected


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
