"""Every registered query against its SQL on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from studyspark.plans.oracle import SQL
from studyspark.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    return x.replace(tzinfo=None) if isinstance(x, datetime.datetime) else x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert df.columns
    if name not in SQL:
        return
    want = duck.sql(SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    got = sorted((tuple(cell(r[c]) for c in cols) for r in rows), key=str)
    assert got == sorted((tuple(cell(r[i]) for i in at) for r in want.fetchall()), key=str)
