import os

import duckdb
import pytest

import __spark_entry__ as entry
from cairnlog.plans import reference_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v != v:
        return None
    v = v.item() if hasattr(v, "item") else v
    return round(v, 6) if isinstance(v, float) else v


def same_rows(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    rows = lambda x: sorted((tuple(map(plain, r)) for r in x[cols].itertuples(index=False, name=None)), key=repr)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(reference_queries.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got = reference_queries.queries()[name](spark, SF).toPandas()
    same_rows(got, duck.sql(reference_queries.oracle_sql()[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.isdir(SF)
