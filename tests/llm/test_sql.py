import duckdb
import pytest

from studyspark.llm import registry

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", registry.ORACLE_SQL)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "pages", "documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(registry.ORACLE_SQL[name])
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted(map(str, (tuple(r[c] for c in cols) for r in df.collect()))) == sorted(map(str, (tuple(r[i] for i in at) for r in want.fetchall())))
