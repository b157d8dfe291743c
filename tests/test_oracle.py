"""Every catalog query against its DuckDB SQL on the data folder."""

import os

import duckdb
import pytest

from tessera import plans

DATA = os.environ.get("TESSERA_TEST_DATA", "/root/testdata/sf0.001")
QUERIES = plans.registry()


def plain(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    return str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    got = QUERIES[name].run(spark, DATA)
    data = got.collect()
    if not QUERIES[name].oracle:
        assert data
        return
    cursor = duck.execute(QUERIES[name].oracle)
    columns = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, data) == rows(columns, want)


def test_every_query_names_operators():
    assert all(q.ops for q in QUERIES.values())
