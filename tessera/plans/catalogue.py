"""The engine's queries over the driver's tables, each with its DuckDB counterpart.

``embeddings`` is read as a vector table: ``id`` is ``vec_id + 1`` (0 is reserved), ``tag`` one bit
for the label. Distances are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vector as V
from tessera.functions.sql import register
from tessera.kv import KVTable
from tessera.operators import ivf, kmeans, search, topk
from tessera.sources import store
from tessera.streaming.topk import StreamingTopK
from tessera.table import VectorTable
from tessera.types import ImportMode, IndexType, Method

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
DIMS = 64

VT = "vt AS (SELECT vec_id + 1 AS id, CAST(1::BIGINT << label AS BIGINT) AS tag, embedding::DOUBLE[] AS v FROM embeddings)"
#: Scaled by the id, so that the three methods rank differently.
VS = f"{VT}, vs AS (SELECT id, tag, list_transform(v, lambda x: CAST(CAST(x * (1 + (id - 1) % 5) AS FLOAT) AS DOUBLE)) AS v FROM vt)"
SQL_DISTANCE = {Method.L2NORM: "list_distance({a}, {b})", Method.COSINE: "list_cosine_similarity({a}, {b})", Method.DOTP: "list_inner_product({a}, {b})"}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def vector_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return df.select((F.col("vec_id") + 1).alias("id"), F.expr("shiftleft(1L, label)").alias("tag"), F.col("embedding").alias("vector"))


def scaled_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = (1 + (F.col("id") - 1) % 5).cast("float")
    return vector_table(spark, sf_dir).withColumn("vector", F.transform("vector", lambda x: x * by))


def vector_of(table: DataFrame, id_: int) -> list[float]:
    return list(table.where(F.col("id") == id_).first()["vector"])


def rounded(c: Column) -> Column:
    return F.round(c, search.PLACES)


# Scalar functions: every row against the vector of id 1.


def _scalar(name: str, f: Callable[[Column, Column], Column], sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        table = scaled_table(spark, sf_dir)
        one = search.query_literal(vector_of(table, 1))
        return table.select("id", rounded(f(F.col("vector"), one)).alias("value"))

    run.__name__ = name
    query(f"WITH {VS} SELECT id, round({sql.format(a='v', b='(SELECT v FROM vs WHERE id = 1)')}, 6) AS value FROM vs")(run)


_scalar("dist_l2", V.l2, "list_distance({a}, {b})")
_scalar("dist_l2_squared", V.l2_squared, "list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))")
_scalar("dist_cosine", V.cosine, "list_cosine_similarity({a}, {b})")
_scalar("dist_dot", V.dot, "list_inner_product({a}, {b})")
_scalar("vec_norm", lambda a, b: V.norm(a), "sqrt(list_inner_product({a}, {a}))")


@query(f"WITH {VS}, n AS (SELECT id, v, sqrt(list_inner_product(v, v)) AS n FROM vs) SELECT id, unnest(range(0, 64))::INTEGER AS pos, round(unnest(list_transform(v, lambda x: x / n)), 6) AS value FROM n")
def vec_normalize(spark, sf_dir):
    return scaled_table(spark, sf_dir).select("id", F.posexplode(V.normalize(F.col("vector"))).alias("pos", "x")).select("id", "pos", rounded(F.col("x")).alias("value"))


@query(
    f"""WITH {VS}, made AS (SELECT id, CASE WHEN id % 3 = 0 THEN list_transform(v, lambda x: 0::DOUBLE) ELSE v END AS v FROM vs)
    SELECT id, CASE WHEN list_inner_product(v, v) = 0 THEN 0 ELSE round(list_cosine_similarity(v, (SELECT v FROM vs WHERE id = 1)), 6) END AS similarity FROM made"""
)
def cosine_zero_norm(spark, sf_dir):
    """Every third vector is made zero."""
    rows = scaled_table(spark, sf_dir)
    one = search.query_literal(vector_of(rows, 1))
    some = F.when(F.col("id") % 3 == 0, F.transform("vector", lambda x: x * F.lit(0.0).cast("float"))).otherwise(F.col("vector"))
    return rows.select("id", rounded(V.cosine(some, one)).alias("similarity"))


@query(
    f"WITH {VS}, one AS (SELECT v AS w FROM vs WHERE id = 1) SELECT id, round(list_distance(v, w), 6) AS l2, round(list_cosine_similarity(v, w), 6) AS cosine, round(list_inner_product(v, w), 6) AS dot FROM vs, one"
)
def sql_functions(spark, sf_dir):
    register(spark)
    scaled_table(spark, sf_dir).createOrReplaceTempView("tessera_scaled")
    return spark.sql(
        """WITH one AS (SELECT vector AS w FROM tessera_scaled WHERE id = 1)
        SELECT /*+ BROADCAST(one) */ id, round(vector_l2(vector, w), 6) AS l2, round(vector_cosine(vector, w), 6) AS cosine, round(vector_dot(vector, w), 6) AS dot
        FROM tessera_scaled CROSS JOIN one"""
    )


@query(f"WITH {VS}, n AS (SELECT id, v, sqrt(list_inner_product(v, v)) AS n FROM vs) SELECT id, unnest(range(0, 64))::INTEGER AS pos, round(unnest(list_transform(v, lambda x: x / n)), 6) AS value FROM n")
def sql_normalize(spark, sf_dir):
    register(spark)
    scaled_table(spark, sf_dir).createOrReplaceTempView("tessera_scaled")
    return spark.sql("SELECT id, pos, round(x, 6) AS value FROM (SELECT id, vector_normalize(vector) AS unit FROM tessera_scaled) LATERAL VIEW posexplode(unit) AS pos, x")


# Search.


def _knn_sql(method: Method, k: int, q: int, where: str = "true", source: str = VS, table: str = "vs") -> str:
    d = SQL_DISTANCE[method].format(a="v", b=f"(SELECT v FROM {table} WHERE id = {q})")
    return f"WITH {source} SELECT id, round({d}, 6) AS distance FROM {table} WHERE {where} ORDER BY distance {'ASC' if method.smaller_is_better else 'DESC'}, id LIMIT {k}"


def _knn(name: str, method: Method, k: int, q: int, tag: int = 0) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = scaled_table(spark, sf_dir)
        return VectorTable(spark, DIMS, method, snapshot=rows).search(vector_of(rows, q), k, tag)

    run.__name__ = name
    query(_knn_sql(method, k, q, f"(tag & {tag}) <> 0" if tag else "true"))(run)


_knn("knn_l2_top10", Method.L2NORM, 10, 1)
_knn("knn_cosine_top10", Method.COSINE, 10, 7)
_knn("knn_dot_top10", Method.DOTP, 10, 42)
_knn("knn_top1", Method.L2NORM, 1, 42)
_knn("knn_tag_any_bit", Method.L2NORM, 10, 1, tag=6)


def _padded_sql(inner: str, k: int, worst: float) -> str:
    return f"WITH hits AS ({inner}), placed AS (SELECT row_number() OVER (ORDER BY distance, id) AS pos, * FROM hits) SELECT CAST(r.pos AS INTEGER) AS pos, coalesce(id, 0) AS id, distance FROM (SELECT unnest(range(1, {k + 1})) AS pos) r LEFT JOIN placed p ON p.pos = r.pos"


def _finite(df: DataFrame) -> DataFrame:
    """Infinity is kept out of results that are compared."""
    return df.withColumn("distance", F.when(F.abs("distance") < float("inf"), F.col("distance")))


@query(_padded_sql(_knn_sql(Method.L2NORM, 5, 1, "(tag & 1048576) <> 0"), 5, 0))
def knn_tag_no_match_padded(spark, sf_dir):
    rows = scaled_table(spark, sf_dir)
    return _finite(VectorTable(spark, DIMS, Method.L2NORM, snapshot=rows).search(vector_of(rows, 1), 5, 1 << 20, pad=True))


#: More than the rows of any of the driver's tables.
PADDED = 2500


@query(_padded_sql(_knn_sql(Method.L2NORM, PADDED, 1), PADDED, 0))
def knn_padded(spark, sf_dir):
    rows = scaled_table(spark, sf_dir)
    return _finite(VectorTable(spark, DIMS, Method.L2NORM, snapshot=rows).search(vector_of(rows, 1), PADDED, pad=True))


def _batch(name: str, method: Method) -> None:
    """Every row whose id is divisible by 50 searches."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = scaled_table(spark, sf_dir)
        return VectorTable(spark, DIMS, method, snapshot=rows).search_batch(rows.where("id % 50 = 0"), 10)

    run.__name__ = name
    d = SQL_DISTANCE[method].format(a="t.v", b="q.v")
    query(
        f"WITH {VS}, scored AS (SELECT q.id AS query_id, t.id AS id, round({d}, 6) AS distance FROM vs t, vs q WHERE q.id % 50 = 0), "
        f"ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance {'ASC' if method.smaller_is_better else 'DESC'}, id) AS INTEGER) AS rank, id, distance FROM scored) SELECT * FROM ranked WHERE rank <= 10"
    )(run)


_batch("knn_batch_l2", Method.L2NORM)
_batch("knn_batch_cosine", Method.COSINE)
_batch("knn_batch_dot", Method.DOTP)

SUBSET = [1, 7, 7, 99_999, 42, 13]
_SUBSET_SQL = f"WITH {VS}, ids AS (SELECT unnest({SUBSET}) AS id) SELECT vs.id, round(list_distance(v, (SELECT v FROM vs WHERE id = 3)), 6) AS distance FROM vs JOIN ids USING (id) ORDER BY distance, id LIMIT 10"


@query(_SUBSET_SQL)
def filter_subset_l2(spark, sf_dir):
    rows = scaled_table(spark, sf_dir)
    return VectorTable(spark, DIMS, snapshot=rows).filter_subset(SUBSET, vector_of(rows, 3), 10)


@query(_padded_sql(_SUBSET_SQL, 10, 0))
def filter_subset_padded(spark, sf_dir):
    rows = scaled_table(spark, sf_dir)
    return _finite(VectorTable(spark, DIMS, snapshot=rows).filter_subset(SUBSET, vector_of(rows, 3), 10, pad=True))


@query(f"WITH {VT} SELECT o_orderkey AS id FROM orders WHERE o_orderkey IN (SELECT id FROM vt)")
def id_contains(spark, sf_dir):
    ids = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"))
    return VectorTable(spark, DIMS, snapshot=vector_table(spark, sf_dir)).contains_batch(ids)


@query(f"WITH {VT} SELECT id, tag, unnest(range(0, 64))::INTEGER AS pos, round(unnest(v), 6) AS value FROM vt WHERE id = 42")
def id_get(spark, sf_dir):
    tag, vector = VectorTable(spark, DIMS, snapshot=vector_table(spark, sf_dir)).get(42)
    return spark.createDataFrame([(42, tag, k, round(x, 6)) for k, x in enumerate(vector)], "id long, tag long, pos int, value double")


@query("SELECT count(*) AS n FROM embeddings")
def table_size(spark, sf_dir):
    return VectorTable(spark, DIMS, snapshot=vector_table(spark, sf_dir)).count()


@query(f"WITH {VT} SELECT tag, count(*) AS n FROM vt GROUP BY tag")
def tag_histogram(spark, sf_dir):
    return vector_table(spark, sf_dir).groupBy("tag").agg(F.count("*").alias("n"))


# Changes over all rows: who is there at first, inserted and changed goes by residues of the id. The
# oracle writes out what must be left.


def changed_table(spark: SparkSession, sf_dir: str) -> VectorTable:
    """Ids ending in 0-6 are there; those ending in 4-9 are inserted (4-6 in vain), every third is
    deleted, every sixth inserted again with the tag 1024, every fifth gets the tag 2048."""
    rows = vector_table(spark, sf_dir)
    table = VectorTable(spark, DIMS, snapshot=rows.where("id % 10 < 7"))
    step = lambda op, where, at, tag=F.col("tag"): rows.where(where).select((F.col("id") * 4 + at).alias("seq"), F.lit(op).alias("op"), "id", tag.cast("long").alias("tag"), F.transform("vector", lambda x: -x).alias("vector"))
    log = step("i", "id % 10 >= 4", 0).union(step("d", "id % 3 = 0", 1)).union(step("i", "id % 6 = 0", 2, F.lit(1024))).union(step("t", "id % 5 = 0", 3, F.lit(2048)))
    table.outcome = table.apply(log)
    return table


_CHANGED = f"""WITH {VT}, final AS (
    SELECT id, CASE WHEN id % 5 = 0 THEN 2048 WHEN id % 6 = 0 THEN 1024 ELSE tag END AS tag,
           CASE WHEN id % 10 >= 7 OR id % 6 = 0 THEN list_transform(v, lambda x: -x) ELSE v END AS v
    FROM vt WHERE id % 3 <> 0 OR id % 6 = 0)"""


@query(f"{_CHANGED} SELECT id, CAST(tag AS BIGINT) AS tag, round(list_sum(v), 6) AS total FROM final")
def table_after_changes(spark, sf_dir):
    state = changed_table(spark, sf_dir).state()
    return state.select("id", "tag", rounded(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x)).alias("total"))


def _search_changed(name: str, q: int, tag: int = 0) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return changed_table(spark, sf_dir).search(vector_of(vector_table(spark, sf_dir), q), 10, tag=tag)

    run.__name__ = name
    where = f"(tag & {tag}) <> 0" if tag else "true"
    query(f"{_CHANGED} SELECT id, round(list_distance(v, (SELECT v FROM vt WHERE id = {q})), 6) AS distance FROM final WHERE {where} ORDER BY distance, id LIMIT 10")(run)


_search_changed("delete_then_search", 1)
_search_changed("delete_then_reinsert", 6, 1024)
_search_changed("set_tag_then_search", 5, 2048)


@query(
    f"""WITH {VT}
    SELECT 'i' AS op, CASE WHEN id % 10 < 7 THEN 'DUPLICATED_ENTRY' ELSE 'SUCCESS' END AS outcome, count(*) AS n FROM vt WHERE id % 10 >= 4 GROUP BY ALL
    UNION ALL SELECT 'd', 'SUCCESS', count(*) FROM vt WHERE id % 3 = 0
    UNION ALL SELECT 'i2', 'SUCCESS', count(*) FROM vt WHERE id % 6 = 0
    UNION ALL SELECT 't', CASE WHEN id % 3 = 0 AND id % 6 <> 0 THEN 'NOT_FOUND_ID' ELSE 'SUCCESS' END, count(*) FROM vt WHERE id % 5 = 0 GROUP BY ALL"""
)
def insert_rejects_duplicates(spark, sf_dir):
    outcome = changed_table(spark, sf_dir).outcome
    return outcome.groupBy(F.when((F.col("op") == "i") & (F.col("seq") % 4 == 2), "i2").otherwise(F.col("op")).alias("op"), "outcome").agg(F.count("*").alias("n"))


def _import(name: str, mode: ImportMode, new: str) -> None:
    """Two of three rows are there; every third and every fifth comes in."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = vector_table(spark, sf_dir)
        table = VectorTable(spark, DIMS, snapshot=rows.where("id % 3 <> 0"))
        incoming = rows.where("id % 3 = 0 OR id % 5 = 0").withColumn("vector", F.transform("vector", lambda x: -x)).withColumn("tag", F.lit(512).cast("long"))
        table.import_rows(incoming, mode)
        return table.state().select("id", "tag", rounded(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x)).alias("total"))

    run.__name__ = name
    query(f"WITH {VT} SELECT id, CAST(CASE WHEN {new} THEN 512 ELSE tag END AS BIGINT) AS tag, round(list_sum(CASE WHEN {new} THEN list_transform(v, lambda x: -x) ELSE v END), 6) AS total FROM vt")(run)


_import("import_overwrite", ImportMode.OVERWRITE, "(id % 3 = 0 OR id % 5 = 0)")
_import("import_ignore", ImportMode.IGNORE, "(id % 3 = 0)")


@query(f"WITH {VT} SELECT id, CASE WHEN id % 3 <> 0 THEN 'DUPLICATED_ENTRY' ELSE 'SUCCESS' END AS outcome FROM vt WHERE id % 3 = 0 OR id % 5 = 0")
def import_outcomes(spark, sf_dir):
    rows = vector_table(spark, sf_dir)
    table = VectorTable(spark, DIMS, snapshot=rows.where("id % 3 <> 0"))
    return table.import_rows(rows.where("id % 3 = 0 OR id % 5 = 0"), ImportMode.IGNORE)


@query(
    f"""WITH {VT} SELECT id, CASE WHEN id = 7 THEN 4096 ELSE tag END AS tag, round(list_sum(v), 6) AS total FROM vt WHERE id <> 3
    UNION ALL SELECT 1000001, 8192, round(list_sum(list_transform(v, lambda x: -x)), 6) FROM vt WHERE id = 1"""
)
def single_changes(spark, sf_dir):
    """One insert, one deletion, one tag and one insert that is deleted again, over the whole table."""
    rows = vector_table(spark, sf_dir)
    table = VectorTable(spark, DIMS, snapshot=rows)
    one = [-x for x in vector_of(rows, 1)]
    table.insert(1_000_001, 8192, one)
    table.delete(3)
    table.set_tag(7, 4096)
    table.insert(1_000_002, 1, one)
    table.delete(1_000_002)
    return table.state().select("id", "tag", rounded(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x)).alias("total"))


_ROWS = f"WITH {VT} SELECT id, tag, round(list_sum(v), 6) AS total FROM vt"


@query(_ROWS)
def export_roundtrip(spark, sf_dir):
    path = store.scratch(spark, "export")
    VectorTable(spark, DIMS, snapshot=vector_table(spark, sf_dir)).export(path)
    table = VectorTable(spark, DIMS)
    table.import_path(path)
    return table.state().select("id", "tag", rounded(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x)).alias("total"))


@query(_ROWS)
def save_load_roundtrip(spark, sf_dir):
    path = store.scratch(spark, "table")
    VectorTable(spark, DIMS, snapshot=vector_table(spark, sf_dir)).save(path)
    return VectorTable.load(spark, path).state().select("id", "tag", rounded(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x)).alias("total"))


@query("SELECT field, value FROM (VALUES ('dims', '64'), ('kind', '\"table\"'), ('method', '\"COSINE\"'), ('params', '{\"M0\": 32, \"ef_construct\": 220, \"ef_search\": 110}'), ('type', '\"hnsw\"')) t(field, value)")
def table_metadata(spark, sf_dir):
    path = store.scratch(spark, "meta")
    VectorTable(spark, DIMS, Method.COSINE, IndexType.HNSW_INDEX, vector_table(spark, sf_dir)).save(path)
    return store.inspect(spark, path)


# Running top-k.


def _distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scaled_table(spark, sf_dir)
    return rows.select("id", rounded(V.l2(F.col("vector"), search.query_literal(vector_of(rows, 1)))).alias("distance"))


@query(_knn_sql(Method.L2NORM, 10, 1))
def topk_merge(spark, sf_dir):
    rows = _distances(spark, sf_dir)
    return topk.merge([rows.where(F.col("id") % 4 == k) for k in range(4)], 10, Method.L2NORM)


@query(_knn_sql(Method.L2NORM, 10**9, 1))
def topk_sort_all(spark, sf_dir):
    return topk.TopK(-1, Method.L2NORM).update(_distances(spark, sf_dir)).close()


@query(_knn_sql(Method.L2NORM, 10, 1))
def topk_merge_streaming(spark, sf_dir):
    path = store.scratch(spark, "stream")
    _distances(spark, sf_dir).repartition(4).write.parquet(f"{path}/in")
    stream = spark.readStream.schema("id long, distance double").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    top = StreamingTopK(spark, f"{path}/state", 10, Method.L2NORM)
    top.start(stream, f"{path}/checkpoint").awaitTermination()
    return top.result()


# Clustering.


def _centres(rows: DataFrame) -> DataFrame:
    return rows.where("id <= 8").select(F.col("id").cast("int").alias("cid"), F.col("vector").alias("centroid"))


_NEAREST = f"""WITH {VS}, scored AS (
    SELECT t.id, CAST(c.id AS INTEGER) AS cid, round(list_sum(list_transform(list_zip(t.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 12) AS d, t.v FROM vs t, vs c WHERE c.id <= 8),
    near AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, cid) = 1)"""


@query(f"{_NEAREST} SELECT id, cid, round(d, 6) AS distance2 FROM near")
def kmeans_assign(spark, sf_dir):
    rows = scaled_table(spark, sf_dir)
    return kmeans.assign(rows, _centres(rows)).select("id", "cid", rounded(F.col("distance2")).alias("distance2"))


@query(f"{_NEAREST}, spread AS (SELECT cid, unnest(range(0, 64))::INTEGER AS pos, unnest(v) AS x FROM near) SELECT cid, pos, round(avg(x), 6) AS mean FROM spread GROUP BY cid, pos")
def kmeans_lloyd_step(spark, sf_dir):
    rows = scaled_table(spark, sf_dir)
    return kmeans.lloyd_step(rows, _centres(rows)).select("cid", "pos", rounded(F.col("mean")).alias("mean"))


def _steps_sql(steps: int) -> str:
    """Lloyd's steps written out one after another."""
    parts = [VS, "c0 AS (SELECT CAST(id AS INTEGER) AS cid, v FROM vs WHERE id <= 8)"]
    for k in range(steps):
        parts.append(f"s{k} AS (SELECT t.id, c.cid, list_sum(list_transform(list_zip(t.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d, t.v FROM vs t, c{k} c)")
        parts.append(f"n{k} AS (SELECT * FROM s{k} QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, cid) = 1)")
        parts.append(f"m{k} AS (SELECT cid, pos, avg(x) AS x FROM (SELECT cid, unnest(range(0, 64)) AS pos, unnest(v) AS x FROM n{k}) GROUP BY cid, pos)")
        parts.append(f"c{k + 1} AS (SELECT cid, list(x ORDER BY pos) AS v FROM m{k} GROUP BY cid)")
    return f"WITH {', '.join(parts)} SELECT cid, unnest(range(0, 64))::INTEGER AS pos, round(unnest(v), 5) AS mean FROM c{steps}"


@query(_steps_sql(4))
def kmeans_four_steps(spark, sf_dir):
    """The training loop from stated centres."""
    rows = scaled_table(spark, sf_dir)
    found = kmeans.refined(kmeans.packed(rows), [list(r["centroid"]) for r in _centres(rows).orderBy("cid").collect()], 4)
    return spark.createDataFrame([(c + 1, k, round(float(x), 5)) for c, v in enumerate(found) for k, x in enumerate(v)], "cid int, pos int, mean double")


@query(f"{_NEAREST} SELECT id, round(d, 6) AS distance2 FROM near")
def kmeans_seed_weights(spark, sf_dir):
    rows = scaled_table(spark, sf_dir)
    return kmeans.seed_weights(rows, _centres(rows)).select("id", rounded(F.col("distance2")).alias("distance2"))


@query()
def kmeans_centroids(spark, sf_dir):
    table = VectorTable(spark, DIMS, snapshot=vector_table(spark, sf_dir)).kmeans_centroids(8, max_iterations=20)
    return table.state().select("id", "tag", "vector")


def _cells(spark: SparkSession, sf_dir: str) -> ivf.CellIndex:
    return ivf.CellIndex.build(scaled_table(spark, sf_dir), store.scratch(spark, "cells"), 8, max_iterations=5)


@query(_knn_sql(Method.L2NORM, 10, 42))
def ivf_search_all_cells(spark, sf_dir):
    return _cells(spark, sf_dir).search(vector_of(scaled_table(spark, sf_dir), 42), 10, probes=8)


@query()
def ivf_search_nprobe(spark, sf_dir):
    return _cells(spark, sf_dir).search(vector_of(scaled_table(spark, sf_dir), 42), 10, probes=3)


@query(_knn_sql(Method.L2NORM, 10, 42, "(tag & 6) <> 0"))
def ivf_search_tagged(spark, sf_dir):
    return _cells(spark, sf_dir).search(vector_of(scaled_table(spark, sf_dir), 42), 10, tag=6)


def graph_table(spark: SparkSession, sf_dir: str) -> VectorTable:
    return VectorTable(spark, DIMS, Method.L2NORM, IndexType.HNSW_INDEX, scaled_table(spark, sf_dir))


@query(_knn_sql(Method.L2NORM, 10, 42))
def hnsw_search(spark, sf_dir):
    """A graph search of this breadth compares more rows than the driver's tables have."""
    return graph_table(spark, sf_dir).search(vector_of(scaled_table(spark, sf_dir), 42), 10)


@query(_knn_sql(Method.L2NORM, 10, 42, "(tag & 6) <> 0"))
def hnsw_search_tagged(spark, sf_dir):
    return graph_table(spark, sf_dir).search(vector_of(scaled_table(spark, sf_dir), 42), 10, tag=6)


@query(_knn_sql(Method.L2NORM, 10, 42, "id % 4 <> 2"))
def hnsw_search_after_changes(spark, sf_dir):
    """Every fourth row is deleted after the cells were made."""
    rows = scaled_table(spark, sf_dir)
    table, query_vector = graph_table(spark, sf_dir), vector_of(rows, 42)
    table.search(query_vector, 1)
    table.apply(rows.where("id % 4 = 2").select(F.col("id").alias("seq"), F.lit("d").alias("op"), "id", "tag", "vector"))
    return table.search(query_vector, 10)


# Key-value tables.


def page_table(spark: SparkSession, sf_dir: str) -> KVTable:
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("url").cast("binary").alias("key"), F.col("html").cast("binary").alias("value"))
    return KVTable(spark, "pages", rows)


def customer_table(spark: SparkSession, sf_dir: str) -> KVTable:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_name").cast("binary").alias("key"), F.col("c_mktsegment").cast("binary").alias("value"))
    return KVTable(spark, "customers", rows)


def shown(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in ("key", "value") if c in df.columns})


@query("WITH k AS (SELECT url FROM pages WHERE page_id % 3 = 0) SELECT url AS key, md5(html) AS digest FROM pages WHERE url IN (SELECT url FROM k)")
def kv_get(spark, sf_dir):
    keys = spark.read.parquet(f"{sf_dir}/pages.parquet").where("page_id % 3 = 0 AND url IS NOT NULL").select(F.col("url").alias("key")).distinct()
    return page_table(spark, sf_dir).get_batch(keys).select(F.col("key").cast("string").alias("key"), F.md5("value").alias("digest"))


@query("SELECT key, c_mktsegment AS value FROM (VALUES ('no such key'), ('Customer#000000001'), ('')) k(key) LEFT JOIN customer ON c_name = key")
def kv_get_missing(spark, sf_dir):
    keys = spark.createDataFrame([("no such key",), ("Customer#000000001",), ("",)], "key string")
    return shown(customer_table(spark, sf_dir).get_batch(keys))


@query("SELECT c_name AS key, CASE WHEN c_custkey % 10 = 0 THEN 'twice' WHEN c_custkey % 5 = 0 THEN 'once' ELSE c_mktsegment END AS value FROM customer UNION ALL SELECT 'new-' || c_custkey, c_mktsegment FROM customer WHERE c_custkey % 7 = 3")
def kv_put_upsert(spark, sf_dir):
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    table = customer_table(spark, sf_dir)
    batch = customer.where("c_custkey % 5 = 0").select("c_custkey", F.col("c_name").alias("key"), F.lit("once").alias("value"))
    batch = batch.union(customer.where("c_custkey % 10 = 0").select(F.col("c_custkey") + 10_000_000, "c_name", F.lit("twice")))
    batch = batch.union(customer.where("c_custkey % 7 = 3").select(F.col("c_custkey"), F.concat(F.lit("new-"), "c_custkey"), "c_mktsegment"))
    table.put_batch(batch.withColumnRenamed("c_custkey", "seq"))
    return shown(table.state())


@query("SELECT c_name AS key, c_mktsegment AS value FROM customer WHERE c_name <> (SELECT min(c_name) FROM customer)")
def kv_del(spark, sf_dir):
    table = customer_table(spark, sf_dir)
    table.delete(bytes(table.state().agg(F.min("key")).first()[0]))
    return shown(table.state())


@query("SELECT url AS key, CAST(strlen(url) AS INTEGER) AS klen, CAST(strlen(html) AS INTEGER) AS vlen FROM pages WHERE starts_with(url, 'https://www')")
def kv_prefix_scan(spark, sf_dir):
    return shown(page_table(spark, sf_dir).prefix_scan(b"https://www")).drop("value")


@query("SELECT url AS key, CAST(strlen(url) AS INTEGER) AS klen, CAST(strlen(html) AS INTEGER) AS vlen FROM pages WHERE starts_with(url, 'http://') ORDER BY url LIMIT 10")
def kv_prefix_scan_limit(spark, sf_dir):
    return shown(page_table(spark, sf_dir).prefix_scan(b"http://", 10)).drop("value")


@query("SELECT url AS key, CAST(strlen(url) AS INTEGER) AS klen, CAST(strlen(html) AS INTEGER) AS vlen FROM pages")
def kv_scan_all(spark, sf_dir):
    return shown(page_table(spark, sf_dir).prefix_scan(b"*")).drop("value")


@query("SELECT count(*) AS n FROM customer")
def kv_size(spark, sf_dir):
    return customer_table(spark, sf_dir).count()


@query("SELECT c_name AS key, c_mktsegment AS value FROM customer")
def kv_roundtrip(spark, sf_dir):
    path = store.scratch(spark, "kv")
    customer_table(spark, sf_dir).save(path)
    return shown(KVTable.load(spark, path).state())


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

