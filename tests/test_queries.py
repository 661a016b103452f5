"""Every page query against its twin in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from leafscan.plans.queries import QUERIES, TWINS

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


def test_every_query_has_a_twin():
    assert QUERIES.keys() == TWINS.keys() and len(QUERIES) >= 50


@pytest.mark.parametrize("name", QUERIES)
def test_twin(spark, duck, name):
    ours, theirs = QUERIES[name](spark, DIR).toArrow(), duck.sql(TWINS[name]).to_arrow_table()
    assert sorted(ours.column_names) == sorted(theirs.column_names)
    rows = [sorted((tuple(plain(v) for v in r) for r in zip(*[t.column(c).to_pylist() for c in sorted(t.column_names)])), key=repr) for t in (ours, theirs)]
    assert rows[0] == rows[1]


def test_entry_and_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
