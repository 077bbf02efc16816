"""Registered queries against their DuckDB twins (TEST_QUERIES picks some by regular expression)."""

import math
import os
import re

import pytest

import __spark_entry__

duckdb = pytest.importorskip("duckdb")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", [n for n in SQL if re.search(os.environ.get("TEST_QUERIES", "."), n)])
def test_query_equals_its_twin(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    twin = duck.sql(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({SQL[name]})")
    assert sorted(duck.sql(SQL[name]).columns) == columns
    got, expected = ([tuple(map(plain, r)) for r in x] for x in (df.select(*(f"`{c}`" for c in columns)).collect(), twin.fetchall()))
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_others_have_rows(spark, sf):
    for name in sorted(set(QUERIES) - set(SQL)):
        if re.match("[a-z]+[0-9]+_", name) and not name.startswith("op"):
            assert not QUERIES[name](spark, sf).isEmpty(), name


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
