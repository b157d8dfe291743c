"""The operator queries that SQL can express, against DuckDB on the data folder."""

import os

import duckdb
import pytest

from tessera.llm import queries
from tests.test_oracle import DATA, rows


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_query(spark, name):
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
    cursor = con.execute(queries.ORACLE_SQL[name])
    columns, want = [d[0] for d in cursor.description], cursor.fetchall()
    got = queries.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want)
    kinds = {r[0]: r[1] for r in con.execute("DESCRIBE " + queries.ORACLE_SQL[name]).fetchall()}
    assert {c: {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR"}[t] for c, t in got.dtypes} == kinds
