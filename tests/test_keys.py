"""Batches of keys where pages share a url."""

from collections import Counter

import duckdb

from tessera.plans import catalogue


def test_a_key_that_is_asked_for_twice(spark, tmp_path):
    pages = [(0, "a", "1"), (3, "a", "2"), (4, "a", "3"), (6, "b", "4"), (7, "c", "5"), (9, None, "6")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = catalogue.queries()["kv_get"](spark, str(tmp_path)).select("key", "digest").collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert Counter(map(tuple, found)) == Counter(con.sql(catalogue.oracle_sql()["kv_get"]).fetchall())
