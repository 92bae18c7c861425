"""k-means over vectors: seeding by squared distance, Lloyd's steps, centroids as a table.

Vectors are packed into blocks of bytes once and written; every pass after that reads the blocks,
compares them with the broadcast centroids by one matrix product, and hands on k partial sums a
task. Seeding is by oversampling rounds: each takes about twice k rows at once, and the driver
chooses k among these few, weighted by the rows near them. The driver holds centroids and seeds only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources import store
from tessera.types import InvalidArgument

#: Bytes of centroids that are broadcast at a time; more are taken in several passes.
BROADCAST_BYTES = 32 << 20
#: Rows of a packed block; rows compared at a time; rounds of seeding and seeds a round, by k.
BLOCK, ROWS, SEED_ROUNDS, OVERSAMPLED = 512, 4096, 3, 2
#: A reader takes a row group's blocks at once; its writer counts bytes from the 100th block on only.
GROUP_BYTES = 16 << 20


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the first nearest centre, and the squared distance to it."""
    found = ((centres * centres).sum(1) - 2 * rows @ centres.T).argmin(1)
    gap = rows - centres[found]
    return found, (gap * gap).sum(1)


def assign(table: DataFrame, centroids: DataFrame) -> DataFrame:
    """``table`` with ``cid`` and ``distance2``: the nearest centroid (``cid``, ``centroid``) by
    squared distance, the smaller ``cid`` of equal ones. Centroids that exceed one broadcast are
    taken in several passes. Rows with a null vector have null for both."""
    listed = centroids.select("cid", "centroid").orderBy("cid").toArrow()
    ids = listed["cid"].to_numpy()
    vectors = np.array(listed["centroid"].to_pylist(), np.float64).reshape(len(ids), -1)
    step = max(1, BROADCAST_BYTES // max(8, vectors.shape[1] * 8))
    # By place, so that columns of any name may be there.
    at = table.columns.index("vector")
    types = table.schema.fields
    named = table.toDF(*(f"c{k}" for k in range(len(types))))
    schema = T.StructType([*named.schema.fields, T.StructField("cid", T.IntegerType()), T.StructField("distance2", T.DoubleType())])
    found = named.withColumns({"cid": F.lit(None).cast("int"), "distance2": F.lit(None).cast("double")})
    for first in range(0, len(ids), step):
        held = table.sparkSession.sparkContext.broadcast((ids[first : first + step], vectors[first : first + step]))
        found = found.mapInArrow(_assigner(held, at, schema.names), schema)
    columns = [F.col(f"c{k}").alias(f.name) for k, f in enumerate(types)]
    return found.select(*columns, "cid", "distance2")


def _assigner(held, at: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, centres = held.value
        for whole in batches:
            for begin in range(0, whole.num_rows, ROWS):
                batch = whole.slice(begin, ROWS)
                there = np.flatnonzero(batch.column(at).is_valid().to_numpy(zero_copy_only=False))
                cid, d = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.float64) for k in (-2, -1))
                if len(there):
                    near, gap = nearest(_matrix(batch.column(at).take(pa.array(there)), len(there)), centres)
                    better = np.isnan(d[there]) | (gap < d[there])
                    cid[there[better]], d[there[better]] = ids[near[better]], gap[better]
                none = np.isnan(d)
                yield pa.record_batch([*batch.columns[:-2], pa.array(np.where(none, 0, cid).astype(np.int32), mask=none), pa.array(d, mask=none)], names)

    return run


def lloyd_step(table: DataFrame, centroids: DataFrame) -> DataFrame:
    """``cid``, ``pos``, ``mean``: the mean of each cluster's rows in every dimension."""
    near = assign(table.select("vector"), centroids).select("cid", F.posexplode("vector").alias("pos", "x"))
    return near.groupBy("cid", "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def seed_weights(table: DataFrame, centres: DataFrame) -> DataFrame:
    """``id``, ``distance2``: squared distance to the nearest centre, the weight of the next seed."""
    return assign(table.select("id", "vector"), centres).select("id", "distance2")


def packed(table: DataFrame) -> DataFrame:
    """``ids``, ``vectors`` as bytes, ``n``: a row for each block of rows, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(begin, BLOCK)
                vectors = _matrix(batch.column(1), batch.num_rows)
                yield pa.record_batch([pa.array([batch.column(0).to_numpy().astype(np.int64).tobytes()]), pa.array([vectors.tobytes()]), pa.array([batch.num_rows], pa.int64())], ["ids", "vectors", "n"])

    path = store.scratch(table.sparkSession, "blocks")
    table.select("id", "vector").where("vector IS NOT NULL").mapInArrow(run, "ids binary, vectors binary, n long").write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    return table.sparkSession.read.parquet(path)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for ids, vectors, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield np.frombuffer(ids, np.int64), np.frombuffer(vectors).reshape(n, -1)


def _drawn(blocks: DataFrame, centres: np.ndarray, wanted: float, seed: int) -> np.ndarray:
    """About ``wanted`` rows, drawn with a chance in proportion to the squared distance to the
    centres. The sum of distances comes first; its number of drawn rows is then bounded by chance
    alone, far under any trouble."""
    held = blocks.sparkSession.sparkContext.broadcast(centres)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of a task without blocks, which a split file leaves, the sum must be a float too.
        whole = sum((float(nearest(v, held.value)[1].sum()) for _, v in _blocks(batches)), 0.0)
        yield pa.record_batch([pa.array([whole], pa.float64())], ["d"])

    whole = blocks.mapInArrow(total, "d double").agg(F.sum("d")).first()[0] or 0.0
    if not whole > 0:
        return np.zeros((0, centres.shape[1]))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, vectors in _blocks(batches):
            # A number between 0 and 1 from the id alone, so that a task that runs again draws alike.
            mixed = (ids.view(np.uint64) + np.uint64(seed * 2 + 1)) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            u = (mixed >> np.uint64(11)).astype(np.float64) / float(1 << 53)
            chosen = vectors[u * whole < wanted * nearest(vectors, held.value)[1]]
            yield pa.record_batch([pa.array([chosen.tobytes()]), pa.array([len(chosen)], pa.int64())], ["vectors", "n"])

    rows = blocks.mapInArrow(draw, "vectors binary, n long").where("n > 0").toArrow()
    found = [np.frombuffer(v.as_py()).reshape(-1, centres.shape[1]) for v in rows["vectors"]]
    return np.unique(np.concatenate([*found, np.zeros((0, centres.shape[1]))]), axis=0)


def _seeds(blocks: DataFrame, k: int, seed: int) -> np.ndarray:
    """Some rounds of oversampling, then k of the drawn rows, each with a chance in proportion to its
    squared distance to those before, times the rows it stands for."""
    first = blocks.select("vectors", "n").where("n > 0").limit(1).first()
    centres = np.frombuffer(first["vectors"]).reshape(first["n"], -1)[:1].copy()
    for turn in range(SEED_ROUNDS):
        drawn = _drawn(blocks, centres, OVERSAMPLED * k, seed + turn)
        if not len(drawn):
            break
        centres = np.unique(np.concatenate([centres, drawn]), axis=0)
    weights = np.zeros(len(centres))
    for cid, (n, _) in _sums(blocks, centres).items():
        weights[cid] = n
    rng = np.random.default_rng(seed)
    found = [int(weights.argmax())]
    while len(found) < min(k, len(centres)):
        chance = weights * nearest(centres, centres[found])[1]
        chance[found] = 0
        if not chance.sum() > 0:
            break
        found.append(int(rng.choice(len(centres), p=chance / chance.sum())))
    return centres[found]


def _sums(blocks: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, np.ndarray]]:
    """Rows and their sum for every centroid that has any."""
    if centroids.nbytes > BROADCAST_BYTES * 8:
        raise InvalidArgument(f"{len(centroids)} centroids are more than one broadcast takes")
    held = blocks.sparkSession.sparkContext.broadcast(centroids)
    schema = "cid int, n long, total binary"

    def table(count: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        there = np.flatnonzero(count)
        return pa.record_batch([pa.array(there, pa.int32()), pa.array(count[there], pa.int64()), pa.array([total[k].tobytes() for k in there], pa.binary())], ["cid", "n", "total"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = held.value
        total, count = np.zeros_like(centres), np.zeros(len(centres), np.int64)
        for _, vectors in _blocks(batches):
            for begin in range(0, len(vectors), ROWS):
                rows = vectors[begin : begin + ROWS]
                near, _ = nearest(rows, centres)
                order = np.argsort(near, kind="stable")
                own, at = np.unique(near[order], return_index=True)
                total[own] += np.add.reduceat(rows[order], at, axis=0)
                count += np.bincount(near, minlength=len(centres))
        yield table(count, total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for cid, n, total in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = found.setdefault(cid, [0, 0.0])
                own[0] += n
                own[1] = own[1] + np.frombuffer(total)
        count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape)
        for cid, (n, x) in found.items():
            count[cid], total[cid] = n, x
        yield table(count, total)

    parts = blocks.mapInArrow(run, schema)
    sums = parts.repartition("cid").mapInArrow(add, schema)
    return {r["cid"]: (r["n"], np.frombuffer(r["total"])) for r in sums.collect()}  # k x dims numbers


def refined(blocks: DataFrame, centres: np.ndarray, max_iterations: int, epsilon: float = 0.0, zero_empty: bool = False) -> np.ndarray:
    """Lloyd's steps until the centres move by less than ``epsilon``, squared and in all."""
    centres = np.asarray(centres, np.float64)
    for _ in range(max_iterations):
        new = np.zeros_like(centres) if zero_empty else centres.copy()
        for cid, (count, total) in _sums(blocks, centres).items():
            new[cid] = total / count
        shift = float(((new - centres) ** 2).sum())
        centres = new
        if shift < epsilon:
            break
    return centres


def centroids(table: DataFrame, k: int, max_iterations: int = 100, epsilon: float = 1e-3, seed: int = 42, zero_empty: bool = False) -> DataFrame:
    """A flat table of ``k`` centroids: ids from 1, tag 0. An empty cluster keeps its centroid, or
    becomes the zero vector with ``zero_empty``."""
    n = table.count()
    if not 0 < k < n:
        raise InvalidArgument("the number of centroids must lie between 0 and that of rows")
    blocks = packed(table)
    centres = _seeds(blocks, k, seed)
    centres = np.concatenate([centres, np.zeros((k - len(centres), centres.shape[1]))])
    centres = refined(blocks, centres, max_iterations, epsilon, zero_empty)
    rows = [(i + 1, 0, c.tolist()) for i, c in enumerate(centres)]
    return table.sparkSession.createDataFrame(rows, "id long, tag long, vector array<float>")
