import random

import pytest

from tessera import types
from tessera.kv import KVTable
from tessera.operators import ivf, kmeans, oplog, search
from tessera.sources import store
from tessera.streaming.topk import StreamingTopK
from tessera.table import VectorTable
from tessera.types import ImportMode, IndexType

LOG = "seq long, op string, id long, tag long, vector array<float>"


def machine(ops):
    """The log one operation at a time."""
    live, outcomes = {}, []
    for seq, op, id_, tag, vector in ops:
        result = "SUCCESS"
        if op == "i":
            if id_ in live:
                result = "DUPLICATED_ENTRY"
            else:
                live[id_] = (tag, vector)
        elif op == "o":
            live[id_] = (tag, vector)
        elif id_ not in live:
            result = "NOT_FOUND_ID"
        elif op == "d":
            del live[id_]
        else:
            live[id_] = (tag, live[id_][1])
        outcomes.append((seq, result))
    return live, outcomes


@pytest.mark.parametrize("seed", [1, 2])
def test_fold_equals_state_machine(spark, seed):
    r = random.Random(seed)
    ops = [(k + 1, r.choice("iidot"), r.randint(1, 60), r.randint(1, 9), [float(k), 0.0]) for k in range(1500)]
    live, outcomes = machine(ops)
    log = spark.createDataFrame(ops, LOG)
    found = {x["id"]: (x["tag"], x["vector"]) for x in oplog.fold(log, "id", ["tag", "vector"], "tag").collect()}
    assert found == live
    assert sorted((x["seq"], x["outcome"]) for x in oplog.outcomes(log, "id").collect()) == outcomes


def test_table_lifecycle(spark, tmp_path):
    t = VectorTable(spark, 2)
    with pytest.raises(types.IndexEmpty):
        t.search([0.0, 0.0], strict=True)
    t.insert(1, 1, [0.0, 1.0])
    t.insert(2, 2, [1.0, 0.0])
    for error, call in (
        (types.DuplicatedEntry, lambda: t.insert(1, 0, [0.0, 0.0])),
        (types.InvalidId, lambda: t.insert(0, 0, [0.0, 0.0])),
        (types.InvalidDimensions, lambda: t.insert(3, 0, [0.0])),
        (types.InvalidVector, lambda: t.insert(3, 0, [float("nan"), 0.0])),
        (types.NotFoundId, lambda: t.delete(9)),
        (types.NotFoundId, lambda: t.set_tag(9, 1)),
        (types.NotImplemented_, lambda: t.update_context(ef_search=5)),
    ):
        with pytest.raises(error):
            call()
    t.set_tag(2, 8)
    assert t.search([1.0, 0.0], 1, tag=8).first()["id"] == 2
    t.delete(1)
    assert not t.contains(1) and t.size() == 1
    t.insert(1, 4, [5.0, 5.0])
    assert t.stats()["insert"]["count"] == 3 and t.name == "flat"
    path = f"file://{tmp_path}/t"
    t.save(path)
    again = VectorTable.load(spark, path)
    assert sorted(map(tuple, again.state().collect())) == sorted(map(tuple, t.state().collect()))
    assert t.compact(f"file://{tmp_path}/c").size() == 2
    with pytest.raises(types.InvalidFile):
        KVTable.load(spark, path)
    graph = VectorTable(spark, 2, "COSINE", IndexType.HNSW_INDEX)
    graph.update_context(ef_search=5, unknown=1)
    assert graph.params["ef_search"] == 5 and graph.name == "hnsw" and "unknown" not in graph.params
    with pytest.raises(types.InvalidIndexType):
        VectorTable(spark, 2, 0, 7)
    with pytest.raises(types.InvalidDimensions):
        VectorTable(spark, 0)


def test_batch_with_faults(spark):
    t = VectorTable(spark, 2)
    out = t.apply(spark.createDataFrame([(1, "i", 0, 0, [1.0, 1.0]), (2, "i", 5, 0, [1.0]), (3, "i", 6, 0, None), (4, "i", 7, 0, [1.0, 2.0]), (5, "i", 7, 0, [9.0, 9.0])], LOG))
    assert {r["seq"]: r["outcome"] for r in out.collect()} == {1: "INVALID_ID", 2: "INVALID_DIMENSIONS", 3: "INVALID_VECTOR", 4: "SUCCESS", 5: "DUPLICATED_ENTRY"}
    assert [list(r["vector"]) for r in t.state().collect()] == [[1.0, 2.0]]


def test_import_modes(spark):
    old = spark.createDataFrame([(1, 1, [1.0])], "id long, tag long, vector array<float>")
    new = spark.createDataFrame([(1, 2, [2.0]), (3, 3, [3.0])], "id long, tag long, vector array<float>")
    for mode, first in ((ImportMode.OVERWRITE, 2), (ImportMode.IGNORE, 1), (ImportMode.IGNORE_VERBOSE, 1), (9, 1)):
        t = VectorTable(spark, 1, snapshot=old)
        t.import_rows(new, mode)
        assert {r["id"]: r["tag"] for r in t.state().collect()} == {1: first, 3: 3}
    with pytest.raises(types.InvalidDimensions):
        VectorTable(spark, 2).import_rows(new)


def test_import_takes_no_bad_rows_and_one_of_an_id(spark):
    rows = [(0, 1, [1.0]), (1, 2, None), (2, 3, [float("nan")]), (3, 4, [3.0]), (3, 5, [4.0]), (4, 6, [5.0]), (None, 7, [1.0])]
    new = spark.createDataFrame([(*r, -k) for k, r in enumerate(rows)], "id long, tag long, vector array<float>, at int")
    old = spark.createDataFrame([(4, 1, [9.0])], "id long, tag long, vector array<float>")
    for mode, order, third, fourth, outcome in ((ImportMode.IGNORE, None, 4, 1, "DUPLICATED_ENTRY"), (ImportMode.IGNORE, "at", 5, 1, "DUPLICATED_ENTRY"), (ImportMode.OVERWRITE, None, 5, 6, "SUCCESS"), (ImportMode.OVERWRITE, "at", 4, 6, "SUCCESS")):
        t = VectorTable(spark, 1, snapshot=old)
        found = {(r["id"], r["outcome"]) for r in t.import_rows(new, mode, order).collect()}
        assert found == {(0, "INVALID_ID"), (None, "INVALID_ID"), (1, "INVALID_VECTOR"), (2, "INVALID_VECTOR"), (3, "SUCCESS"), (4, outcome)}
        assert {r["id"]: r["tag"] for r in t.state().collect()} == {3: third, 4: fourth}
    with pytest.warns(UserWarning, match="^1 ids"):
        VectorTable(spark, 1, snapshot=old).import_rows(new, ImportMode.IGNORE_VERBOSE)


def test_a_thousand_single_changes(spark, monkeypatch):
    """They stay in the driver up to a bound, and then in a log that is compacted."""
    from tessera import table as module

    t = VectorTable(spark, 2)
    for k in range(1, 1001):
        t.insert(k, k, [float(k), 0.0])
    assert t.log is None and t.size() == 1000
    monkeypatch.setattr(module, "BUFFERED", 40)
    monkeypatch.setattr(module, "MOST_BATCHES", 3)
    for k in range(1, 200, 2):
        t.delete(k)
    t.set_tag(2, 77)
    assert t.batches < 3 and len(t.buffer) < 40
    assert t.size() == 900 and t.get(2) == (77, [2.0, 0.0]) and not t.contains(1) and t.contains(1000)
    kv = KVTable(spark)
    for k in range(500):
        kv.put(b"%d" % k, b"v%d" % k)
    kv.delete(b"7")
    assert kv.size() == 499 and kv.get(b"8") == b"v8"


def test_unchanged_rows_stay_where_they_are(spark):
    base = spark.range(1, 5001).selectExpr("id", "id AS tag", "array(CAST(id AS FLOAT)) AS vector")
    t = VectorTable(spark, 1, snapshot=base)
    t.apply(spark.createDataFrame([(1, "d", 5, None, None), (2, "t", 6, 99, None)], LOG))
    plan = t.state()._jdf.queryExecution().executedPlan().toString()
    same = plan.split("Union")[1].split("\n:- ")[1].split("\n+- ")[0] if "\n:- " in plan else plan
    assert "BroadcastHashJoin" in same.split("BroadcastExchange")[0] and "hashpartitioning" not in same.split("BroadcastExchange")[0]
    assert t.size() == 4999 and t.get(6)[0] == 99


def test_a_hot_id_is_several_groups(spark, monkeypatch):
    monkeypatch.setattr(oplog, "RUN", 16)
    r = random.Random(5)
    ops = [(k + 1, r.choice("iiddot"), r.choice([1, 1, 1, 2]), 1, [float(k), 0.0]) for k in range(600)]
    assert sorted((x["seq"], x["outcome"]) for x in oplog.outcomes(spark.createDataFrame(ops, LOG), "id").collect()) == machine(ops)[1]


def test_destroyed_tables(spark):
    with VectorTable(spark, 1) as t:
        t.insert(1, 1, [1.0])
    for call in (t.state, lambda: t.insert(2, 1, [1.0]), lambda: t.search([1.0]), t.size):
        with pytest.raises(types.InvalidIndex):
            call()
    with KVTable(spark) as kv:
        kv.put(b"a", b"b")
    for call in (kv.state, lambda: kv.put(b"a", b"b"), lambda: kv.get(b"a")):
        with pytest.raises(types.KVInvalidTable):
            call()


def test_order_of_faults(spark):
    t = VectorTable(spark, 2)
    t.insert(1, 1, [1.0, 2.0])
    for error, args in ((types.InvalidId, (0, 1, None)), (types.InvalidVector, (1, 1, None)), (types.DuplicatedEntry, (1, 1, [1.0])), (types.InvalidDimensions, (2, 1, [1.0]))):
        with pytest.raises(error):
            t.insert(*args)


def test_graph_type_searches_cells(spark, monkeypatch):
    """Recall with the usual parameters, a wider search, and changes after the cells were made."""
    import numpy as np

    rng = np.random.default_rng(8)
    centres = rng.standard_normal((60, 16))
    vectors = (centres[rng.integers(0, 60, 6000)] + 0.4 * rng.standard_normal((6000, 16))).astype(np.float32)
    rows = spark.createDataFrame([(k + 1, 1 << (k % 3), v.tolist()) for k, v in enumerate(vectors)], "id long, tag long, vector array<float>").repartition(4).cache()
    exact = VectorTable(spark, 16, snapshot=rows)
    table = VectorTable(spark, 16, "L2NORM", IndexType.HNSW_INDEX, rows)
    table.update_context(ef_search=20)
    queries = [vectors[k].tolist() for k in range(0, 6000, 600)]
    ids = lambda df: {r["id"] for r in df.collect()}
    want = [ids(exact.search(q, 10)) for q in queries]
    found = [ids(table.search(q, 10)) for q in queries]
    assert sum(len(a & b) for a, b in zip(want, found, strict=True)) >= 0.9 * 100
    looked = table.cells.near(queries[0], 10, "L2NORM", table.params).count()
    assert 20 * 32 <= looked < 3000
    table.update_context(ef_search=110)
    assert table.cells.near(queries[0], 10, "L2NORM", table.params).count() > looked
    assert ids(table.search(queries[3], 10, tag=2)) == ids(exact.search(queries[3], 10, tag=2))
    table.delete(1)
    table.insert(10_001, 1, queries[0])
    table.apply(spark.createDataFrame([(1, "d", 601, None, None), (2, "i", 602, 1, [9.0] * 16), (3, "t", 603, 8, None)], LOG))
    first = [r["id"] for r in table.search(queries[0], 3).collect()]
    assert first[0] == 10_001 and 1 not in first
    assert 601 not in ids(table.search(queries[1], 10))
    assert [r["id"] for r in table.search([9.0] * 16, 1).collect()] != [602]  # it was there already, elsewhere
    assert VectorTable(spark, 16, "L2NORM", IndexType.HNSW_INDEX).search(queries[0], 3).count() == 0


def test_seeds_spread_and_centroids_in_several_passes(spark, monkeypatch):
    rows = spark.createDataFrame([(k, 0, [float(k % 5) * 10, float(k) / 1000]) for k in range(1, 501)], "id long, tag long, vector array<float>")
    blocks = kmeans.packed(rows)
    seeds = kmeans._seeds(blocks, 5, 42)
    assert sorted(int(round(s[0] / 10)) for s in seeds) == [0, 1, 2, 3, 4]
    centres = spark.createDataFrame([(k, [10.0 * k, 0.0]) for k in range(5)], "cid int, centroid array<double>")
    once = sorted(map(tuple, kmeans.assign(rows, centres).select("id", "cid", "distance2").collect()))
    monkeypatch.setattr(kmeans, "BROADCAST_BYTES", 32)
    assert sorted(map(tuple, kmeans.assign(rows, centres).select("id", "cid", "distance2").collect())) == once
    same = spark.createDataFrame([(k, 0, [1.0, 1.0]) for k in range(1, 9)], "id long, tag long, vector array<float>")
    assert kmeans.centroids(same, 3).count() == 3


def test_kv(spark, tmp_path):
    kv = KVTable(spark, "names")
    kv.put(b"a1", b"x")
    kv.put(b"a2", b"y")
    kv.put(b"a1", b"z")
    kv.put(b"\xff\x00", b"\x00")
    assert kv.get(b"a1") == b"z" and kv.size() == 3
    assert [bytes(r["key"]) for r in kv.prefix_scan(b"a").collect()] == [b"a1", b"a2"]
    assert kv.prefix_scan(b"*").count() == 3 and kv.prefix_scan(b"a", 1).count() == 1 and kv.prefix_scan(b"zz").count() == 0
    kv.delete(b"a1")
    for error, call in ((types.KVKeyNotFound, lambda: kv.get(b"a1")), (types.KVInvalidKey, lambda: kv.put(b"", b"x")), (types.KVInvalidValue, lambda: kv.put(b"x", b"")), (types.KVKeyNotFound, lambda: kv.delete(b"no"))):
        with pytest.raises(error):
            call()
    path = f"file://{tmp_path}/kv"
    kv.save(path)
    again = KVTable.load(spark, path)
    assert again.name == "names" and again.get(b"\xff\x00") == b"\x00"
    empty = f"file://{tmp_path}/empty"
    KVTable(spark).save(empty)
    assert KVTable.load(spark, empty).size() == 0


def test_binary_files(spark, tmp_path):
    rows = [(i, i * 2, [i + 0.5, i + 1.5, -i]) for i in range(1, 6)]
    (tmp_path / "v.bin").write_bytes(store.vector_file(rows, 0, 3))
    found = sorted((r["id"], r["tag"], list(r["vector"])) for r in store.read_vector_files(spark, f"file://{tmp_path}/v.bin").collect())
    assert found == [(i, t, list(map(float, v))) for i, t, v in rows]
    pairs = [(b"k", b"v" * 9), (b"\x00", b"w")]
    (tmp_path / "k.bin").write_bytes(store.kv_file(pairs))
    assert sorted((bytes(r["key"]), bytes(r["value"])) for r in store.read_kv_files(spark, f"file://{tmp_path}/k.bin").collect()) == sorted(pairs)
    (tmp_path / "graph.bin").write_bytes(store.vector_file(rows, 1, 3, store.GRAPH_MAGIC))
    table = VectorTable.load_binary(spark, f"file://{tmp_path}/graph.bin")
    assert (table.dims, table.method.name, table.name, table.size()) == (3, "COSINE", "hnsw", 5)
    flat = VectorTable(spark, 3)
    flat.insert(2, 9, [0.0, 0.0, 1.0])
    assert {r["id"]: r["outcome"] for r in flat.import_binary(f"file://{tmp_path}/v.bin").collect()}[2] == "DUPLICATED_ENTRY" and flat.size() == 5
    with pytest.raises(types.InvalidDimensions):
        VectorTable.load_binary(spark, f"file://{tmp_path}/{{v,graph}}.bin")
    written = store.write_vector_files(spark.createDataFrame([(i, t, list(map(float, v))) for i, t, v in rows], "id long, tag long, vector array<float>").coalesce(1), f"file://{tmp_path}/written", 0, 3).collect()
    assert [bytes(r["content"]) for r in written] == [store.vector_file(rows, 0, 3)]
    assert KVTable.load_binary(spark, f"file://{tmp_path}/k.bin", "kv").get(b"k") == b"v" * 9
    for bad in (b"", b"x" * 60, store.vector_file(rows, 0, 3)[:-1]):
        with pytest.raises(types.InvalidFile):
            store.vector_header(bad)
    with pytest.raises(types.InvalidFile):
        list(store.parse_kv_file(store.kv_file(pairs)[:-1]))


def test_errors():
    assert types.index_strerror(0) == "success" and types.index_strerror(11) == types.DuplicatedEntry.message
    assert types.table_strerror(1) == types.KVKeyNotFound.message and types.table_strerror(99) == "unknown error"


def test_kmeans_and_cells(spark, tmp_path):
    r = random.Random(3)
    centres = [(0, 0), (10, 0), (0, 10), (10, 10)]
    rows = [(k + 1, 1, [c[0] + r.gauss(0, 0.3), c[1] + r.gauss(0, 0.3)]) for k, c in enumerate(centres * 100)]
    table = spark.createDataFrame(rows, "id long, tag long, vector array<float>")
    found = sorted(tuple(round(x) for x in row["vector"]) for row in kmeans.centroids(table, 4).collect())
    assert found == sorted(centres)
    for k in (0, 400):
        with pytest.raises(types.InvalidArgument):
            kmeans.centroids(table, k)
    index = ivf.CellIndex.build(table, f"file://{tmp_path}/cells", 4)
    exact = [x["id"] for x in search.knn(table, [0.0, 0.0], 10).collect()]
    assert [x["id"] for x in index.search([0.0, 0.0], 10, probes=4).collect()] == exact
    assert [x["id"] for x in index.search([0.0, 0.0], 10, probes=2).collect()] == exact
    assert [x["id"] for x in index.search([0.0, 0.0], 10, tag=1).collect()] == exact
    assert "PartitionFilters: [isnotnull" in index.search([0.0, 0.0], 10, probes=1)._jdf.queryExecution().executedPlan().toString() or index.cells_for([0.0, 0.0], 10, 1)


def test_streaming_top_k(spark, tmp_path):
    rows = spark.createDataFrame([(i, float((i * 37) % 101)) for i in range(1, 101)], "id long, distance double")
    rows.repartition(5).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    top = StreamingTopK(spark, f"file://{tmp_path}/state", 5, "L2NORM")
    top.start(stream, f"file://{tmp_path}/checkpoint").awaitTermination()
    assert top.result().collect() == rows.orderBy("distance", "id").limit(5).collect()
