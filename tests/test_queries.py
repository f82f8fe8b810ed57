"""Every demand query against its SQL on the smallest tables, and the entry."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tallyspark.plans.oracle import ORACLE_SQL
from tallyspark.plans.queries import QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    return con


def rows(df: pd.DataFrame, columns: list[str]) -> list:
    plain = lambda v: None if pd.isna(v) else float(v) if hasattr(v, "__float__") else str(v).replace(" 00:00:00", "")
    return sorted(str([plain(v) for v in r]) for r in df[columns].itertuples(index=False, name=None))


KINDS = {
    "tinyint": "integer", "smallint": "integer", "int": "integer", "integer": "integer", "bigint": "integer", "hugeint": "integer", "float": "float", "double": "float",
    "string": "text", "varchar": "text", "timestamp_ntz": "time", "timestamp": "time", "timestamp_s": "time", "date": "date", "boolean": "boolean",
}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    query, sql = QUERIES[name](spark, DIR), duck.sql(ORACLE_SQL[name])
    kinds = {c: KINDS[str(t).lower()] for c, t in zip(sql.columns, sql.types, strict=True)}
    assert {c: KINDS[t] for c, t in query.dtypes} == kinds
    got, want = query.toPandas(), sql.df()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns) and rows(got, columns) == rows(want, columns)


def test_every_sql_is_text():
    assert all(isinstance(x, str) and x.strip() for x in entry.oracle_sql().values())


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
