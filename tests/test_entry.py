import pytest

import __spark_entry__ as entry
from tessera.plans import catalogue

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"


def test_entry(spark):
    assert entry.entry(spark).count() == 10


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("embeddings", "pages", "customer", "orders"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    result = con.sql(catalogue.oracle_sql()[name])
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in result.fetchall())
