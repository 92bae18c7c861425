"""Search over k-means cells: the Spark counterpart of a graph index.

Rows are written partitioned by their nearest centroid; a search reads the cells whose centroids are
nearest to the query, by a static filter on the partition column, so that other files are not opened.

The parameters of a graph steer the cells. A graph search of breadth ``ef`` over nodes of ``M0``
neighbours compares about ``ef * M0`` rows, and so many rows the nearest cells together must hold. The
centroids are trained on ``ef_construct`` rows a cell.

A cell's radius bounds how near to a query any of its rows can be. From the k-th distance that the nearest
cells give follow the cells that may hold a nearer row, and these make the search exact.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import kmeans, search
from tessera.sources import store
from tessera.types import InvalidArgument, Method

DEFAULT_PROBES = 8
#: What rounding to six places, and the order of adding, may move a distance by.
MARGIN = 1e-5
#: The most cells of a table's index, and rows that a file of a cell holds.
MOST_CELLS, FILE_ROWS = 4096, 200_000


def breadth(k: int, ef_search: int = 110) -> int:
    """How many rows a search should look at, at least."""
    return 2 * k if k > ef_search else ef_search


class CellIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.rows, self.meta = store.load(spark, path, ("cells",))
        self.centroids = np.array(self.meta["centroids"])
        self.sizes = {int(k): v for k, v in self.meta["sizes"].items()}
        self.radii = np.array([self.meta.get("radii", {}).get(str(c + 1), float("inf")) for c in range(len(self.centroids))])
        self.probes = self.meta.get("probes", DEFAULT_PROBES)

    @classmethod
    def build(cls, table: DataFrame, path: str, cells: int, probes: int = DEFAULT_PROBES, sample: int | None = None, **options) -> CellIndex:
        """``sample``: rows a cell on which the centroids are trained (all rows by default)."""
        n = table.count()
        each = max(1, n // (cells * sample)) if sample else 1
        chosen = table if each == 1 else table.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(each)) == 0)
        centres = kmeans.centroids(chosen, cells, **options)
        cid = centres.select(F.col("id").cast("int").alias("cid"), F.col("vector").alias("centroid"))
        placed = store.written(kmeans.assign(table.select("id", "tag", "vector"), cid), "placed")
        measured = placed.where("cid IS NOT NULL").groupBy("cid").agg(F.count("*").alias("n"), F.sqrt(F.max("distance2")).alias("radius")).collect()
        sizes = {r["cid"]: r["n"] for r in measured}
        radii = {r["cid"]: r["radius"] for r in measured}
        # A cell is spread over as many files as its size asks for.
        files = table.sparkSession.createDataFrame([(c, -(-m // FILE_ROWS)) for c, m in sizes.items()], "cid int, files int")
        dealt = placed.join(F.broadcast(files), "cid").withColumn("file", F.pmod(F.xxhash64("id"), F.col("files")))
        dealt.repartition("cid", "file").select("id", "tag", "vector", "cid").write.mode("overwrite").partitionBy("cid").parquet(f"{path}/rows")
        listed = [list(r["vector"]) for r in centres.orderBy("id").collect()]
        meta = {"kind": "cells", "centroids": listed, "sizes": sizes, "radii": radii, "probes": probes}
        table.sparkSession.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
        return cls(table.sparkSession, path)

    @classmethod
    def for_table(cls, table: DataFrame, params: dict[str, int]) -> CellIndex:
        """About the square root of the rows as cells."""
        n = table.count()
        cells = max(1, min(MOST_CELLS, n - 1, round(n**0.5)))
        if n < 2:
            cells = 1
            table = table.union(table)  # one row is its own centroid
        return cls.build(table, store.scratch(table.sparkSession, "cells"), cells, sample=max(2, params["ef_construct"]), max_iterations=10)

    def near(self, vector: Sequence[float], k: int, method: Method | str | int, params: dict[str, int]) -> DataFrame:
        """The rows of the cells nearest to ``vector`` that hold about as many rows as a graph
        search would compare."""
        need = breadth(k, params["ef_search"]) * params["M0"]
        return self.rows.where(F.col("cid").isin(self._until(self._ranked(vector, method), 1, need)))

    def within(self, vector: Sequence[float], method: Method | str | int, worst: float) -> DataFrame:
        """The rows of all cells that may hold a row as good as ``worst`` or better."""
        method, query = Method.of(method), np.asarray(vector, np.float32).astype(np.float64)
        length, norms = np.sqrt(query @ query), np.sqrt((self.centroids**2).sum(1))
        if method is Method.L2NORM:
            bound = self.radii - np.sqrt(((self.centroids - query) ** 2).sum(1))
            may = bound >= -worst - MARGIN * (1 + abs(worst))
        elif method is Method.DOTP:
            may = self.centroids @ query + length * self.radii >= worst - MARGIN * (1 + abs(worst))
        else:
            # The widest angle between a row and its centroid; any, where the cell reaches the origin.
            scale = norms * length
            between = np.arccos(np.clip(np.divide(self.centroids @ query, scale, out=np.ones_like(scale), where=scale > 0), -1, 1))
            widest = np.where(self.radii < norms, np.arcsin(np.minimum(1, np.divide(self.radii, norms, out=np.ones_like(norms), where=norms > self.radii))), np.pi)
            may = np.cos(np.maximum(0, between - widest)) >= worst - MARGIN
        found = [int(c) + 1 for c in np.flatnonzero(may | ~np.isfinite(self.radii)) if int(c) + 1 in self.sizes]
        return self.rows if len(found) == len(self.sizes) else self.rows.where(F.col("cid").isin(found))

    def _ranked(self, vector: Sequence[float], method: Method | str | int = Method.L2NORM) -> np.ndarray:
        query = np.asarray(vector, np.float64)
        product = self.centroids @ query
        if Method.of(method) is Method.DOTP:
            away = -product
        elif Method.of(method) is Method.COSINE:
            norms = np.sqrt((self.centroids**2).sum(1))
            away = -np.divide(product, norms, out=np.zeros_like(product), where=norms > 0)
        else:
            away = ((self.centroids - query) ** 2).sum(1)
        return np.argsort(away, kind="stable")

    def _until(self, ranked: np.ndarray, probes: int, need: int) -> list[int]:
        found, rows = [], 0
        for c in ranked:
            if len(found) >= probes and rows >= need:
                break
            found.append(int(c) + 1)
            rows += self.sizes.get(int(c) + 1, 0)
        return found

    def with_params(self, probes: int) -> CellIndex:
        if probes < 1:
            raise InvalidArgument("probes")
        self.probes = probes
        return self

    def cells_for(self, vector: Sequence[float], k: int, probes: int | None = None) -> list[int]:
        """The nearest cells; more, until they hold enough rows."""
        return self._until(self._ranked(vector), probes or self.probes, breadth(k))

    def search(self, vector: Sequence[float], k: int, method: Method | str | int = Method.L2NORM, tag: int = 0, probes: int | None = None) -> DataFrame:
        """A tag filter makes the search exact: it scans all cells."""
        rows = self.rows if tag else self.rows.where(F.col("cid").isin(self.cells_for(vector, k, probes)))
        return search.knn(rows, vector, k, method, tag)
