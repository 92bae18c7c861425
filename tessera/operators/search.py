"""Exact nearest-neighbour search and ranking over vector tables (``id``, ``tag``, ``vector``).

One query plans as ``TakeOrderedAndProject``; many queries go through an Arrow kernel that takes
a block of rows against a block of queries, keeps k rows a query, and is merged by a window. Its memory
is that of one such block and of the rows kept.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import vector as V
from tessera.sources import store
from tessera.types import InvalidArgument, InvalidDimensions, InvalidVector, Method

#: Distances are rounded to so many places, so that they do not depend on the order of adding.
PLACES = 6
#: Queries and rows that the kernel compares at a time, pairs that it measures at a time, and the most bytes of
#: queries that are broadcast.
QUERY_BLOCK, ROW_BLOCK, PAIRS = 512, 2048, 1 << 15
BROADCAST_BYTES = 8 << 20
#: A little more than rounding moves two distances apart.
STEP = 2 * 10.0**-PLACES
#: What the order of adding may move a product by, as a share of the lengths.
SLACK = 1e-10


def distance(method: Method | str | int, a: Column, b: Column) -> Column:
    method = Method.of(method)
    return {Method.L2NORM: V.l2, Method.COSINE: V.cosine, Method.DOTP: V.dot}[method](a, b)


def best_first(method: Method | str | int, column: str = "distance") -> list[Column]:
    """Ties go to the smaller id; null and NaN are never better than a number."""
    d = F.col(column)
    d = F.when(F.isnan(d), None).otherwise(d)
    return [(d.asc_nulls_last() if Method.of(method).smaller_is_better else d.desc_nulls_last()), F.col("id")]


def tagged(table: DataFrame, tag: int) -> DataFrame:
    """Rows that share a bit with ``tag``; 0 means all rows."""
    return table if tag == 0 else table.where(F.col("tag").bitwiseAND(F.lit(tag)) != 0)


def query_literal(vector: Sequence[float] | None, dims: int | None = None) -> Column:
    if vector is None or any(x is None or x != x or x in (float("inf"), float("-inf")) for x in vector):
        raise InvalidVector()
    if dims is not None and len(vector) != dims:
        raise InvalidDimensions(f"{len(vector)} for {dims}")
    return F.lit(np.asarray(vector, np.float32).astype(float).tolist()).cast("array<float>")


def knn(table: DataFrame, vector: Sequence[float], k: int, method: Method | str | int = Method.L2NORM, tag: int = 0, pad: bool = False, dims: int | None = None) -> DataFrame:
    """``id``, ``distance`` of the k best rows, best first."""
    if k < 1:
        raise InvalidArgument("k")
    d = F.round(distance(method, F.col("vector"), query_literal(vector, dims)), PLACES).alias("distance")
    found = tagged(table, tag).select("id", d).orderBy(*best_first(method)).limit(k)
    return padded(found, k, method) if pad else found


def padded(found: DataFrame, k: int, method: Method | str | int) -> DataFrame:
    """``pos``, ``id``, ``distance``: exactly k rows, filled with id 0 and the worst value."""
    placed = found.withColumn("pos", F.row_number().over(Window.orderBy(*best_first(method))))  # k rows at most
    places = found.sparkSession.range(1, k + 1).select(F.col("id").cast("int").alias("pos"))
    return places.join(F.broadcast(placed), "pos", "left").select("pos", F.coalesce("id", F.lit(0)).alias("id"), F.coalesce("distance", F.lit(Method.of(method).worst)).alias("distance"))


def filter_subset(table: DataFrame, ids: Sequence[int], vector: Sequence[float], k: int, method: Method | str | int = Method.L2NORM, pad: bool = False, dims: int | None = None) -> DataFrame:
    """The k best among ``ids``: unknown ids are skipped, repeated ids count each time."""
    if k < 1:
        raise InvalidArgument("k")
    wanted = table.sparkSession.createDataFrame([(int(i),) for i in ids], "id long")
    pruned = table.where(F.col("id").isin(*map(int, set(ids)))) if 0 < len(ids) <= 1000 else table
    return knn(pruned.join(wanted, "id"), vector, k, method, 0, pad, dims)


def _scores(method: Method, rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    product = queries @ rows.T
    if method is Method.DOTP:
        return product
    rn, qn = np.sqrt((rows * rows).sum(1)), np.sqrt((queries * queries).sum(1))
    if method is Method.COSINE:
        scale = qn[:, None] * rn[None, :]
        return np.divide(product, scale, out=np.zeros_like(product), where=scale > 0)
    return (qn * qn)[:, None] + (rn * rn)[None, :] - 2 * product  # the squared distance, for the choice only


def knn_batch(table: DataFrame, queries: DataFrame, k: int, method: Method | str | int = Method.L2NORM, exclude_self: bool = False) -> DataFrame:
    """``query_id``, ``rank``, ``id``, ``distance`` for ``queries`` (``id``, ``vector``).

    Queries are counted first: up to ``BROADCAST_BYTES`` of them are broadcast and the table is
    scanned once. More are taken part by part, each with its own scan whose result is written before
    the next part is read, so that the driver never holds more than one part.
    """
    method = Method.of(method)
    if k < 1:
        raise InvalidArgument("k")
    spark = table.sparkSession
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dims")).first()
    parts = max(1, -(-size["n"] * (8 + 4 * (size["dims"] or 0)) // BROADCAST_BYTES))
    schema = "query_id long, id long, distance double"
    found = None
    for part in range(parts):
        chosen = queries if parts == 1 else queries.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part)
        rows = chosen.select("id", "vector").toArrow()
        ids = rows["id"].to_numpy()
        vectors = np.array(rows["vector"].to_pylist(), np.float32).reshape(len(ids), size["dims"] or 0)
        held = spark.sparkContext.broadcast((ids, vectors))
        one = table.select("id", "vector").mapInArrow(_kernel(held, k, method, exclude_self), schema)
        if parts > 1:
            one = store.written(_best(one, k, method), "nearest")
            held.destroy()
        found = one if found is None else found.union(one)
    if parts > 1:
        return found
    return _best(found, k, method)


def _best(found: DataFrame, k: int, method: Method) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(*best_first(method))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def _kernel(held, k: int, method: Method, exclude_self: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = held.value
        sign = 1 if method.smaller_is_better else -1
        # Per query the k best so far, best first, as signed rounded distances; NaN is the worst.
        # As many places as there were rows, up to k.
        best_d, best_id = np.zeros((len(ids), 0)), np.zeros((len(ids), 0), np.int64)
        filled = np.zeros(len(ids), np.int64)
        for batch in batches:
            all_ids = batch.column(0).to_numpy()
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            whole = flat.reshape(len(all_ids), -1) if len(all_ids) else flat.reshape(0, vectors.shape[1])
            if more := min(k - best_d.shape[1], len(all_ids)):
                best_d = np.pad(best_d, ((0, 0), (0, more)), constant_values=np.nan)
                best_id = np.pad(best_id, ((0, 0), (0, more)))
            for begin in range(0, len(all_ids), ROW_BLOCK):
                row_ids, rows = all_ids[begin : begin + ROW_BLOCK], whole[begin : begin + ROW_BLOCK].astype(np.float64)
                for at in range(0, len(ids), QUERY_BLOCK):
                    own = slice(at, min(at + QUERY_BLOCK, len(ids)))
                    queries = vectors[own].astype(np.float64)
                    scores = sign * _scores(method, rows, queries)
                    itself = row_ids[None, :] == ids[own, None] if exclude_self else None
                    limit = _limit(method, scores, itself, queries, rows, best_d[own], k)
                    may = ~(scores > limit[:, None])
                    if itself is not None:
                        may &= ~itself
                    for q, r in _pairs(may):
                        d = sign * np.round(_exact_pairs(method, rows, queries, q, r), PLACES)
                        _merge(best_d[own], best_id[own], filled[own], q, d, row_ids[r], k)
        for at in range(0, len(ids), QUERY_BLOCK):
            there = np.arange(best_d.shape[1])[None, :] < filled[at : at + QUERY_BLOCK, None]
            q, place = np.nonzero(there)
            yield pa.record_batch([pa.array(ids[at + q]), pa.array(best_id[at + q, place]), pa.array(sign * best_d[at + q, place] + 0.0)], ["query_id", "id", "distance"])

    return run


def _limit(method: Method, scores: np.ndarray, itself: np.ndarray | None, queries: np.ndarray, rows: np.ndarray, best: np.ndarray, k: int) -> np.ndarray:
    """For each query the largest score that can still be one of the k best: the k-th so far or of these
    rows, and what rounding may move it by."""
    kth = best[:, k - 1] + STEP if best.shape[1] == k else np.full(len(best), np.nan)  # as distances; NaN while there are fewer
    squared = method is Method.L2NORM
    size = np.sqrt((queries * queries).sum(1)) + np.sqrt((rows * rows).sum(1).max(initial=0))
    limit = np.where(np.isnan(kth), np.inf, kth * kth if squared else kth)
    open_ = np.flatnonzero(np.isinf(limit) | ((scores <= limit[:, None]).sum(1) > 4 * k))
    need = k if itself is None else k + 1
    if len(open_) and scores.shape[1] > need:
        here = np.partition(scores[open_], need - 1, axis=1)[:, need - 1]
        if squared:
            here = (np.sqrt(np.maximum(here, 0) + SLACK * size[open_] ** 2) + STEP) ** 2
        limit[open_] = np.fmin(limit[open_], here if squared else here + STEP)
    return limit + SLACK * size * size


def _pairs(may: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of what is true, a bounded number at a time."""
    flat = np.flatnonzero(may)
    for begin in range(0, len(flat), PAIRS):
        yield np.divmod(flat[begin : begin + PAIRS], may.shape[1])


def _exact_pairs(method: Method, rows: np.ndarray, queries: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
    a, b = rows[r], queries[q]
    if method is Method.L2NORM:
        gap = a - b
        return np.sqrt((gap * gap).sum(1))
    product = (a * b).sum(1)
    if method is Method.DOTP:
        return product
    scale = np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1))
    return np.divide(product, scale, out=np.zeros_like(product), where=scale != 0)


def _merge(best_d: np.ndarray, best_id: np.ndarray, filled: np.ndarray, q: np.ndarray, d: np.ndarray, ids: np.ndarray, k: int) -> None:
    """Some pairs of queries and rows into the k best of each query, in place."""
    touched = np.unique(q)
    old_q, place = np.nonzero(np.arange(best_d.shape[1])[None, :] < filled[touched, None])
    all_q = np.concatenate([touched[old_q], q])
    all_d = np.concatenate([best_d[touched][old_q, place], d])
    all_id = np.concatenate([best_id[touched][old_q, place], ids])
    order = np.lexsort((all_id, all_d, all_q))
    all_q, all_d, all_id = all_q[order], all_d[order], all_id[order]
    rank = np.arange(len(all_q)) - np.searchsorted(all_q, all_q)
    kept = rank < k
    best_d[all_q[kept], rank[kept]], best_id[all_q[kept], rank[kept]] = all_d[kept], all_id[kept]
    filled[touched] = np.minimum(k, np.bincount(all_q, minlength=len(filled))[touched])
