"""SQL of the corpus operators: text only, and equal to the queries on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tallyspark.llm.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"


def test_sql_is_text():
    assert all(isinstance(v, str) for v in entry.oracle_sql().values()) and set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, DIR)
    assert sorted(want.columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)
