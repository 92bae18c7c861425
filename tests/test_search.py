import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import vector as V
from tessera.operators import search, topk
from tessera.types import InvalidArgument, InvalidDimensions, InvalidMethod, InvalidVector, Method

SCHEMA = "id long, tag long, vector array<float>"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    return [(i + 1, 1 << (i % 5), [float(x) for x in rng.standard_normal(6).astype(np.float32)]) for i in range(300)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def brute(rows, q, k, method, keep=lambda r: True):
    q = np.array(q, np.float64)
    out = []
    for i, _, v in filter(keep, rows):
        v = np.array(v, np.float64)
        d = {Method.L2NORM: lambda: math.dist(v, q), Method.DOTP: lambda: float(v @ q), Method.COSINE: lambda: float(v @ q / (np.linalg.norm(v) * np.linalg.norm(q)))}[method]()
        out.append((round(d, 6) * (1 if method.smaller_is_better else -1), i))
    return [i for _, i in sorted(out)[:k]]


@pytest.mark.parametrize("method", list(Method))
@pytest.mark.parametrize("tag", [0, 6])
def test_knn_is_sort_all_then_take(table, rows, method, tag):
    q = rows[41][2]
    found = [r["id"] for r in search.knn(table, q, 9, method, tag).collect()]
    assert found == brute(rows, q, 9, method, lambda r: not tag or r[1] & tag)


@pytest.mark.parametrize("method", list(Method))
def test_batch_equals_single(table, rows, method):
    found = search.knn_batch(table, table.where("id <= 20"), 7, method).collect()
    for q in range(1, 21):
        own = [r["id"] for r in sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])]
        assert own == brute(rows, rows[q - 1][2], 7, method)


def test_batch_ties_go_to_the_smaller_id_and_self_can_be_left_out(spark):
    same = spark.createDataFrame([(i, 0, [1.0, 0.0]) for i in range(40, 0, -1)], SCHEMA)
    found = search.knn_batch(same, same.where("id = 3"), 3, exclude_self=True).orderBy("rank").collect()
    assert [r["id"] for r in found] == [1, 2, 4]


def test_batch_takes_queries_in_several_scans(table, rows, monkeypatch):
    monkeypatch.setattr(search, "BROADCAST_BYTES", 200)
    found = search.knn_batch(table, table.where("id <= 20"), 3).collect()
    assert {r["query_id"] for r in found} == set(range(1, 21)) and len(found) == 60


def test_plan_is_a_top_k(spark, rows):
    plan = search.knn(spark.createDataFrame(rows, SCHEMA), [0.0] * 6, 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan


def test_padding(table, spark):
    few = table.where("id <= 3")
    padded = search.knn(few, [0.0] * 6, 5, pad=True).orderBy("pos").collect()
    assert [r["id"] for r in padded][3:] == [0, 0] and padded[4]["distance"] == math.inf
    none = search.knn(few, [1.0] * 6, 2, Method.COSINE, tag=1 << 40, pad=True).collect()
    assert [(r["id"], r["distance"]) for r in none] == [(0, -1.0), (0, -1.0)]


def test_subset_skips_unknown_and_keeps_repeats(table, rows):
    found = [r["id"] for r in search.filter_subset(table, [7, 1, 7, 9999], rows[6][2], 10).collect()]
    assert found == [7, 7, 1]
    assert search.filter_subset(table, [], rows[0][2], 4, pad=True).count() == 4


def test_faults(table):
    with pytest.raises(InvalidArgument):
        search.knn(table, [0.0] * 6, 0)
    with pytest.raises(InvalidVector):
        search.knn(table, None, 1)
    with pytest.raises(InvalidVector):
        search.knn(table, [math.nan] * 6, 1)
    with pytest.raises(InvalidDimensions):
        search.knn(table, [0.0] * 5, 1, dims=6)
    with pytest.raises(InvalidMethod):
        Method.of("L7")


def test_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, b array<float>")
    a, b = F.col("a"), F.col("b")
    row = df.select(V.l2(a, b), V.l2_squared(a, b), V.norm(a), V.cosine(a, b), V.normalize(a), V.normalize(b), V.dot(a, a)).first()
    assert list(row) == [5.0, 25.0, 5.0, 0.0, [0.6, 0.8], None, 25.0]


def test_nan_is_never_better(spark):
    df = spark.createDataFrame([(1, math.nan), (2, 0.5), (3, None), (4, 0.9)], "id long, distance double")
    for method, order in ((Method.COSINE, [4, 2]), (Method.L2NORM, [2, 4])):
        assert [r["id"] for r in topk.TopK(4, method).update(df).close().collect()][:2] == order


def test_top_k_of_parts_is_top_k_of_all(table):
    d = table.select("id", F.round(V.norm(F.col("vector")), 6).alias("distance"))
    parts = [d.where(F.col("id") % 3 == k) for k in range(3)]
    for method in (Method.L2NORM, Method.DOTP):
        whole = d.orderBy(*search.best_first(method)).limit(8).collect()
        assert topk.merge(parts, 8, method).collect() == whole
    top = topk.TopK(8, Method.L2NORM)
    for p in parts:
        top.update(p)
    assert top.close(3).collect() == d.orderBy("distance", "id").limit(3).collect()
    assert topk.TopK(-1, 0).update(d).close().count() == 300
    with pytest.raises(InvalidArgument):
        topk.TopK(0, 0)


def test_registered_batch_takes_all_rows_and_several_scans(spark, monkeypatch):
    from tessera.plans import catalogue

    sf = "/root/testdata/sf0.1"
    whole = catalogue.queries()["knn_batch_l2"](spark, sf).collect()
    n = catalogue.vector_table(spark, sf).where("id % 50 = 0").count()
    assert len(whole) == 10 * n and max(r["query_id"] for r in whole) > 300
    monkeypatch.setattr(search, "BROADCAST_BYTES", 4_000)
    assert sorted(catalogue.queries()["knn_batch_l2"](spark, sf).collect()) == sorted(whole)
