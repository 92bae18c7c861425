"""Operator 6, approximate nearest neighbours by collision counting.

Vectors are projected on ``PROJECTIONS`` fixed random lines. Every projection is kept as one sorted
array with the vectors' places. A query opens a window around its own projection in each array; a
vector inside a window collides there. Windows widen level by level (virtual rehashing: the same
arrays, a larger radius, only the new margins are read), and vectors whose collisions reach the
threshold are verified by their exact distance. The first radius comes from the distances of some
rows of the block. The search ends when the windows reach the distance of the k-th verified vector:
one at that distance collides in a line with probability 0.68, and the threshold lies two standard
deviations under the mean of that, so about 98 of 100 of the true neighbours are verified.

Rows are made one an id (combined before the shuffle) and packed where they then are into written
blocks of at most ``BLOCK_ROWS``; queries into blocks of ``QUERY_ROWS``. Every block is sorted once, by
one task, and all query blocks pass through it. Each gives k rows a query, and a window merges
those. Of equal vectors in a block the k + 1 smallest ids stand for all: no other can be among the
k nearest of any query. Work grows with queries times rows, as blocks are searched one by one; the
share of a block that a query reads depends on how near its neighbours are against all others.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and rows
with a null id, take no part; vectors keep their own precision; vectors of different lengths never
meet; rows that share an id count as one, that with the smallest vector; ties go to the smaller id;
fewer than k candidates are all returned; no query or no candidate gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialise

PROJECTIONS = 128
SEED = 20_011
BLOCK_ROWS = 8192
QUERY_ROWS = 2048
#: Windows end at this many times the k-th distance; they begin at ``FIRST`` of what that is for some
#: ``PROFILE`` rows of the block, and widen by ``GROWTH`` a level.
REACH = 1.0
FIRST, PROFILE = 0.85, 32
GROWTH = 1.2
#: Share of the arrays' entries from which on a level's collisions are counted by vector.
DENSE = 0.05
#: Lines whose collisions are counted at a time, few enough for the processor's cache (and for a byte).
LINES = 16
DEVIATIONS = 2.0


@cache
def lines(dims: int) -> np.ndarray:
    """Directions by dimensions, the same in every task."""
    return np.random.default_rng([SEED, dims]).standard_normal((dims, PROJECTIONS))


def threshold(m: int = PROJECTIONS) -> int:
    p = math.erf(REACH / math.sqrt(2))
    return max(1, math.floor(m * p - DEVIATIONS * math.sqrt(m * p * (1 - p))))


class Tile:
    """The sorted arrays of one block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.k = k
        by_id = np.argsort(ids, kind="stable")
        ids, vectors = ids[by_id], vectors[by_id]
        same = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.itemsize * vectors.shape[1]))).ravel()
        _, first, group = np.unique(same, return_index=True, return_inverse=True)
        self.vectors = vectors[first]
        rows = np.argsort(group, kind="stable")
        starts = np.searchsorted(group[rows], np.arange(len(first) + 1))
        self.members = [ids[rows[a : min(b, a + k + 1)]] for a, b in zip(starts[:-1], starts[1:], strict=True)]
        projected = (self.vectors @ lines(vectors.shape[1])).T
        self.order = np.argsort(projected, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(projected, self.order, axis=1)
        self.low, self.span = float(self.sorted.min()), float(self.sorted.max() - self.sorted.min())
        step = 4 * self.span + 1  # keeps the arrays apart in one sorted row
        self.shift = np.arange(len(self.sorted)) * step - self.low
        self.flat = (self.sorted + self.shift[:, None]).ravel()
        # Every vector's place in each line's array; a window is a range of places.
        self.places = np.empty(self.order.shape, np.uint16 if len(self.vectors) < 1 << 16 else np.uint32)
        np.put_along_axis(self.places, self.order, np.arange(len(self.vectors), dtype=self.places.dtype)[None, :], axis=1)
        self.norms = np.einsum("ij,ij->i", self.vectors, self.vectors)
        self.radius = self._profile()
        #: Entries read, vectors verified and queries, for measurements.
        self.read = self.verified = self.queries = 0

    def _profile(self) -> float:
        """The median distance of the k-th neighbour, for some rows spread over the block."""
        some = self.vectors[:: max(1, len(self.vectors) // PROFILE)]
        squares = (some * some).sum(1)[:, None] + self.norms[None, :] - 2 * (some @ self.vectors.T)
        at = min(self.k, squares.shape[1] - 1)
        return float(np.sqrt(np.maximum(np.median(np.partition(squares, at, axis=1)[:, at]), 0.0)))

    def _collide(self, counts: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """A vector is in a line's array once, so that its places are counted one line at a time."""
        for own, a, b in zip(self.order, starts.tolist(), ends.tolist(), strict=True):
            if b > a:
                counts[own[a:b]] += 1

    def _collide_all(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """All collisions of windows that hold much of the arrays: the same, in one pass over the
        places by vector, which then costs less than following the arrays. A place is in a window if
        it is less than the window's width behind its begin, in whole numbers that wrap around."""
        counts = np.zeros(len(self.vectors), np.int16)
        begin, width = (x.astype(self.places.dtype)[:, None] for x in (lo, hi - lo))
        for at in range(0, len(self.places), LINES):
            own = slice(at, at + LINES)
            inside = self.places[own] - begin[own] < width[own]
            counts += np.add.reduce(inside.view(np.uint8), axis=0, dtype=np.uint8)
        return counts

    def _near(self, new: np.ndarray, query: np.ndarray, found: list[tuple[float, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Of the vectors to verify those that can be among the k nearest, and their exact distances.
        Many are first compared by products, with room for their rounding."""
        if len(new) > 16 * self.k:
            rough = self.norms[new] + query @ query - 2 * (self.vectors[new] @ query)
            slack = 1e-9 * (self.norms[new].max() + query @ query)
            bound = np.partition(rough, self.k)[self.k]
            if len(found) >= self.k:
                bound = min(bound, found[-1][0] ** 2)
            new = new[rough <= bound + slack]
        gaps = self.vectors[new] - query
        distances = np.sqrt((gaps * gaps).sum(1))
        if len(found) >= self.k:
            near = distances <= found[-1][0]
            new, distances = new[near], distances[near]
        return new, distances

    def search(self, query_id: int, query: np.ndarray) -> list[tuple[float, int]]:
        """The k nearest found, as distance and id."""
        n, m = len(self.vectors), len(self.sorted)
        own = query @ lines(len(query))
        centre = np.clip(own, self.low - self.span, self.low + 2 * self.span)
        base = np.arange(m) * n
        need = threshold(m)
        counts = np.zeros(n, np.int16)
        checked = np.zeros(n, bool)
        found: list[tuple[float, int]] = []
        half = max(FIRST * REACH * self.radius, self.span / 128, 1e-9) + float(np.abs(own - centre).max())
        lo = hi = np.clip(np.searchsorted(self.flat, centre + self.shift) - base, 0, n)
        self.queries += 1
        while True:
            left = np.maximum(own - half, self.low - self.span)
            right = np.minimum(own + half, self.low + 2 * self.span)
            new_lo = np.minimum(lo, np.clip(np.searchsorted(self.flat, left + self.shift, "left") - base, 0, n))
            new_hi = np.maximum(hi, np.clip(np.searchsorted(self.flat, right + self.shift, "right") - base, 0, n))
            margin = int((new_hi - new_lo).sum() - (hi - lo).sum())
            self.read += margin
            if margin > DENSE * n * m:
                counts = self._collide_all(new_lo, new_hi)
            else:
                self._collide(counts, new_lo, lo)
                self._collide(counts, hi, new_hi)
            lo, hi = new_lo, new_hi
            new = np.flatnonzero((counts >= need) & ~checked)
            if len(new):
                checked[new] = True
                self.verified += len(new)
                new, distances = self._near(new, query, found)
                found += [(float(d), int(i)) for d, at in zip(distances, new, strict=True) for i in self.members[at] if i != query_id]
                found = sorted(found)[: self.k]
            everything = int((hi - lo).min()) == n
            if everything or (len(found) >= self.k and half >= REACH * found[-1][0]):
                return found
            half *= GROWTH
            if len(found) >= self.k:
                half = min(half, max(REACH * found[-1][0], half / GROWTH * 1.01))


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``id``, ``v``: one row an id."""
    v = F.col("v")
    fine = F.col("id").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v")).where(fine)
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def packed(rows: DataFrame, block_rows: int) -> DataFrame:
    """``block``, ``dims``, ``ids``, ``vectors`` as bytes: blocks of rows as the tasks hold them."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        number = TaskContext.get().partitionId() << 33

        def flush(dims: int) -> pa.RecordBatch:
            nonlocal number
            parts = held.pop(dims)
            ids, vectors = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            number += 1
            values = [[number], [dims], [ids.tobytes()], [vectors.tobytes()]]
            return pa.record_batch([pa.array(c, t) for c, t in zip(values, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["block", "dims", "ids", "vectors"])

        for whole in batches:
            for at in range(0, whole.num_rows, block_rows):
                batch = whole.slice(at, block_rows)
                ids, lengths = batch.column(0).to_numpy(), pc.list_value_length(batch.column(1)).to_numpy()
                for dims in np.unique(lengths).tolist():
                    own = np.flatnonzero(lengths == dims)
                    vectors = batch.column(1).take(pa.array(own)).flatten().to_numpy().reshape(len(own), dims)
                    parts = held.setdefault(dims, [])
                    if parts and sum(len(p[0]) for p in parts) + len(own) > block_rows:
                        yield flush(dims)
                        parts = held.setdefault(dims, [])
                    parts.append((ids[own], vectors))
        for dims in list(held):
            yield flush(dims)

    return rows.select("id", "v").mapInArrow(pack, "block long, dims int, ids binary, vectors binary")


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` for the queries that ``is_query`` (over the
    column ``id``) marks."""
    rows = usable(vectors, id_column, vector_column)
    blocks = materialise(packed(rows, block_rows), "blocks")
    queries = materialise(packed(rows.where(is_query), QUERY_ROWS), "queries")
    slots = max(1, blocks.count())
    columns = ["dims", "ids", "vectors"]
    data = blocks.select(F.pmod(F.xxhash64("block"), F.lit(slots)).cast("int").alias("slot"), F.lit(0).alias("kind"), *columns)
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"), F.lit(1).alias("kind"), *columns)
    dealt = data.union(asked).repartition(slots, "slot").sortWithinPartitions("slot", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tiles = None, []
        for batch in batches:
            for one in range(batch.num_rows):
                row = batch.slice(one, 1).to_pylist()[0]
                if row["slot"] != at:
                    at, tiles = row["slot"], []
                ids, own = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["vectors"], "<f8").reshape(-1, row["dims"])
                if not row["kind"]:
                    tiles.append((row["dims"], Tile(ids, own, k)))
                    continue
                for dims, tile in tiles:
                    if dims != row["dims"]:
                        continue
                    out = [(int(q), i, d) for q, v in zip(ids, own, strict=True) for d, i in tile.search(int(q), v)]
                    columns = list(zip(*out, strict=True)) if out else [(), (), ()]
                    yield pa.record_batch([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(run, "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
