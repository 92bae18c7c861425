"""Cells and clustering where tables are split into more tasks than they have blocks, and where cells overlap."""

import duckdb
import numpy as np
import pytest

from tessera.plans import catalogue
from tessera.table import VectorTable
from tessera.types import IndexType, Method

SF = "/root/testdata/sf0.001"


@pytest.fixture
def split(spark):
    """Files are cut smaller than a row group, so that tasks without rows are among the others."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("name", ["hnsw_search", "hnsw_search_after_changes", "ivf_search_all_cells", "ivf_search_tagged"])
def test_tasks_without_rows(split, name):
    found = catalogue.queries()[name](split, SF)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    result = con.sql(catalogue.oracle_sql()[name])
    assert sorted(tuple(r[c] for c in result.columns) for r in found.collect()) == sorted(result.fetchall())


def test_probes_and_tasks_without_rows(split):
    found = {r["id"]: r["distance"] for r in catalogue.queries()["ivf_search_nprobe"](split, SF).collect()}
    rows = catalogue.scaled_table(split, SF)
    exact = {r["id"]: r["distance"] for r in VectorTable(split, 64, snapshot=rows).search(catalogue.vector_of(rows, 42), 500).collect()}
    assert len(found) == 10 and found.items() <= exact.items()


def test_centroids_and_tasks_without_rows(split):
    found = catalogue.queries()["kmeans_centroids"](split, SF).collect()
    assert sorted(r["id"] for r in found) == list(range(1, 9)) and np.isfinite([r["vector"] for r in found]).all()


@pytest.mark.parametrize("method", list(Method))
def test_cells_lose_no_row(spark, method):
    """Vectors without structure, of which the nearest cells hold a part only."""
    rng = np.random.default_rng(5)
    vectors = (rng.standard_normal((3000, 12)) + 0.3 * rng.standard_normal(12)).astype(np.float32)
    rows = spark.createDataFrame([(k + 1, 1, v.tolist()) for k, v in enumerate(vectors)], "id long, tag long, vector array<float>").repartition(4).cache()
    exact, table = VectorTable(spark, 12, method, snapshot=rows), VectorTable(spark, 12, method, IndexType.HNSW_INDEX, rows)
    table.update_context(ef_search=10, ef_construct=20)
    for q in vectors[:4].tolist():
        assert table.search(q, 10).collect() == exact.search(q, 10).collect()
    assert table.cells.within(vectors[0].tolist(), method, exact.search(vectors[0].tolist(), 1).first()["distance"]).count() < 3000


def test_blocks_are_read_a_few_at_a_time(spark):
    import pyarrow.parquet as pq

    from tessera.operators import kmeans

    rows = spark.range(1, 120_001, 1, 1).selectExpr("id", "transform(sequence(1, 64), x -> CAST(hash(id, x) AS FLOAT)) AS vector")
    metas = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in kmeans.packed(rows).inputFiles()]
    sizes = [m.row_group(g).total_byte_size for m in metas for g in range(m.num_row_groups)]
    assert sum(sizes) > 40e6 and max(sizes) < 40e6
