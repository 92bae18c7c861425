"""The vector table: keyed rows (``id``, ``tag``, ``vector``) with changes, search and persistence.

A table is a snapshot, a log of batches of operations, and a bounded buffer of single changes that
the driver holds. Its state is computed when it is read: unchanged rows are filtered only, changed
ones folded. A full buffer goes to the log as one batch, and a log of ``MOST_BATCHES`` is written
into the next snapshot; ``compact`` does so at once.
"""

from __future__ import annotations

import time
import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import kmeans, oplog, search
from tessera.operators.ivf import CellIndex
from tessera.sources import store
from tessera.types import (
    LOG_SCHEMA,
    VECTOR_SCHEMA,
    DuplicatedEntry,
    ImportMode,
    IndexEmpty,
    IndexType,
    InvalidDimensions,
    InvalidId,
    InvalidIndex,
    InvalidIndexType,
    InvalidVector,
    Method,
    NotFoundId,
    NotImplemented_,
)

#: Single changes the driver holds, and batches in the log, before they are written.
BUFFERED, MOST_BATCHES = 4096, 16


class TimeStat:
    def __init__(self):
        self.count, self.total, self.last, self.min, self.max = 0, 0.0, 0.0, None, 0.0

    def add(self, ms: float) -> None:
        self.count += 1
        self.total += ms
        self.last = ms
        self.min = ms if self.min is None else min(self.min, ms)
        self.max = max(self.max, ms)


def finite(v):
    """Whether a column of vectors holds numbers only."""
    return v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


class VectorTable:
    def __init__(self, spark: SparkSession, dims: int, method: Method | str | int = Method.L2NORM, index_type: IndexType | int = IndexType.FLAT_INDEX, snapshot: DataFrame | None = None):
        if not 0 < dims <= 65_535:
            raise InvalidDimensions(str(dims))
        if index_type not in set(IndexType):
            raise InvalidIndexType(str(index_type))
        self.spark, self.dims, self.method, self.type = spark, dims, Method.of(method), IndexType(index_type)
        self._snapshot = spark.createDataFrame([], VECTOR_SCHEMA) if snapshot is None else snapshot.select("id", "tag", "vector")
        self.began_empty = snapshot is None
        self.log: DataFrame | None = None
        self.changes = self.batches = self.seq = 0
        #: By id, the row that a single change has left, or None where it was deleted.
        self.buffer: dict[int, tuple[int, list[float]] | None] = {}
        self.params = {"ef_search": 110, "ef_construct": 220, "M0": 32}
        self.cells: CellIndex | None = None
        self.timings = {name: TimeStat() for name in ("insert", "delete", "dump", "search")}

    @property
    def name(self) -> str:
        return self.type.label

    @property
    def snapshot(self) -> DataFrame:
        if self._snapshot is None:
            raise InvalidIndex("the table was destroyed")
        return self._snapshot

    def _timed(self, name: str, began: float) -> None:
        self.timings[name].add((time.monotonic() - began) * 1000)

    def stats(self) -> dict[str, dict]:
        return {name: dict(vars(t)) for name, t in self.timings.items()}

    # Life

    def destroy(self) -> None:
        """Gives up all rows; every later use raises ``InvalidIndex``. Saved copies stay."""
        self._snapshot = self.log = self.cells = None
        self.buffer = {}

    def __enter__(self) -> VectorTable:
        return self

    def __exit__(self, *_) -> None:
        self.destroy()

    # State

    def _logged(self) -> DataFrame:
        """The state without the buffer."""
        if self.log is None:
            return self.snapshot
        return oplog.state(self.snapshot, self.log, self.changes, "id", ["tag", "vector"], "tag")

    def _overlaid(self, rows: DataFrame) -> DataFrame:
        """``rows`` of the logged state after the buffered changes; their number is bounded."""
        if not self.buffer:
            return rows
        ids = self.spark.createDataFrame([(i,) for i in self.buffer], "id long")
        live = self.spark.createDataFrame([(i, *row) for i, row in self.buffer.items() if row], VECTOR_SCHEMA)
        return rows.join(F.broadcast(ids), "id", "left_anti").select("id", "tag", "vector").union(live)

    def state(self) -> DataFrame:
        return self._overlaid(self._logged())

    def size(self) -> int:
        return self.count().first()["n"]

    def count(self) -> DataFrame:
        """The number of rows, as one row ``n``."""
        return self.state().agg(F.count("*").alias("n"))

    def _find(self, id_: int) -> tuple[int, list[float]] | None:
        if id_ in self.buffer:
            return self.buffer[id_]
        if self.began_empty and self.log is None:
            self.snapshot  # noqa: B018 - a destroyed table raises
            return None
        where = F.col("id") == id_
        rows = self.snapshot.where(where)
        if self.log is not None:
            # The fold is by id, so that one id needs its own entries only.
            rows = oplog.fold(oplog.as_log(rows, "id", ["tag", "vector"]).union(self.log.where(where)), "id", ["tag", "vector"], "tag")
        row = rows.select("tag", "vector").first()
        return None if row is None else (row["tag"], list(row["vector"]))

    def get(self, id_: int) -> tuple[int, list[float]]:
        """Tag and vector of an id."""
        return self._known(id_)

    def contains(self, id_: int) -> bool:
        return self._find(id_) is not None

    def contains_batch(self, ids: DataFrame) -> DataFrame:
        return ids.join(self.state().select("id"), "id", "left_semi")

    def compact(self, path: str) -> VectorTable:
        """Write the state to ``path`` and go on from there."""
        self.save(path)
        self._rebase(f"{path}/rows")
        return self

    def _rebase(self, path: str) -> None:
        self._snapshot = self.spark.read.parquet(path).select("id", "tag", "vector")
        self.log, self.changes, self.batches, self.buffer, self.cells, self.began_empty = None, 0, 0, {}, None, False

    # Changes

    def _append(self, rows: DataFrame, changes: int) -> None:
        self.log = rows if self.log is None else self.log.union(rows)
        self.changes += changes
        self.batches += 1
        if self.batches >= MOST_BATCHES:
            path = store.scratch(self.spark, "snapshot")
            self.state().write.parquet(path)
            self._rebase(path)

    def _hold(self, id_: int, row: tuple[int, list[float]] | None) -> None:
        self.buffer[id_] = row
        if len(self.buffer) >= BUFFERED:
            self.flush()

    def flush(self) -> None:
        """The buffered changes become one batch of the log."""
        if self.buffer:
            self.seq += 1
            rows = [(self.seq, "o", i, *row) if row else (self.seq, "d", i, None, None) for i, row in self.buffer.items()]
            self.buffer = {}
            self._append(self.spark.createDataFrame(rows, LOG_SCHEMA), len(rows))

    def _check_vector(self, vector: Sequence[float] | None) -> None:
        if vector is None or any(x is None or x != x or x in (float("inf"), float("-inf")) for x in vector):
            raise InvalidVector()
        if len(vector) != self.dims:
            raise InvalidDimensions(f"{len(vector)} for {self.dims}")

    def insert(self, id_: int, tag: int, vector: Sequence[float]) -> None:
        """Faults in this order: id, missing vector, known id, then the vector's own."""
        began = time.monotonic()
        if id_ == 0:
            raise InvalidId()
        if vector is None:
            raise InvalidVector()
        if self.contains(id_):
            raise DuplicatedEntry(str(id_))
        self._check_vector(vector)
        self._hold(id_, (tag, [float(x) for x in vector]))
        self._timed("insert", began)

    def delete(self, id_: int) -> None:
        began = time.monotonic()
        self._known(id_)
        self._hold(id_, None)
        self._timed("delete", began)

    def set_tag(self, id_: int, tag: int) -> None:
        self._hold(id_, (tag, self._known(id_)[1]))

    def _known(self, id_: int) -> tuple[int, list[float]]:
        if id_ == 0:
            raise InvalidId()
        row = self._find(id_)
        if row is None:
            raise NotFoundId(str(id_))
        return row

    def apply(self, operations: DataFrame) -> DataFrame:
        """A batch of operations (``seq``, ``op``, ``id``, ``tag``, ``vector``), in the order of
        their own ``seq``; gives their outcomes. Rows that break the table's rules have none of
        them applied and are reported as INVALID_ID, INVALID_VECTOR or INVALID_DIMENSIONS."""
        self.flush()
        v = F.col("vector")
        holds_vector = F.col("op").isin("i", "o")
        fault = F.when(F.col("id") == 0, "INVALID_ID").when(holds_vector & ~finite(v), "INVALID_VECTOR").when(holds_vector & (F.size(v) != self.dims), "INVALID_DIMENSIONS")
        marked = operations.select((F.col("seq") + self.seq).alias("seq"), "op", "id", "tag", v.cast("array<float>").alias("vector")).withColumn("fault", fault)
        good = marked.where("fault IS NULL").drop("fault")
        measured = marked.agg(F.max("seq").alias("last"), F.count("*").alias("n")).first()
        touched = self._logged().join(oplog.keys_of(good, "id", measured["n"]), "id", "left_semi")
        done = oplog.outcomes(oplog.as_log(touched, "id", ["tag", "vector"]).union(good), "id")
        done = done.where(F.col("seq") > self.seq).select("seq", "op", "id", "outcome")
        self.seq = measured["last"] or self.seq
        self._append(good, measured["n"])
        return done.union(marked.where("fault IS NOT NULL").select("seq", "op", "id", F.col("fault").alias("outcome")))

    def import_rows(self, rows: DataFrame, mode: ImportMode | int = ImportMode.IGNORE, order: str | None = None) -> DataFrame:
        """Rows of another table: known ids are replaced, or left alone with any other mode. Gives
        ``id``, ``outcome`` of each row's id: SUCCESS, DUPLICATED_ENTRY (left alone), INVALID_ID or
        INVALID_VECTOR (not taken). Of rows that share an id the last one by ``order`` replaces, the
        first one is inserted; without that column rows are ordered by tag and vector. Vectors of
        another length stop the import. The verbose mode warns with the number left alone."""
        self.flush()
        v = F.col("vector")
        measured = rows.agg(F.max(F.when(F.size("vector") != self.dims, 1)).alias("other"), F.count("*").alias("n")).first()
        if measured["other"]:
            raise InvalidDimensions()
        overwrite = mode == ImportMode.OVERWRITE
        fault = F.when(F.col("id").isNull() | (F.col("id") == 0), "INVALID_ID").when(~finite(v), "INVALID_VECTOR")
        marked = rows.select("id", F.col("tag").cast("long").alias("tag"), v.cast("array<float>").alias("vector"), F.lit(0).alias("order") if order is None else F.col(order).alias("order")).withColumn("fault", fault)
        row = F.struct("order", "tag", "vector")
        single = marked.where("fault IS NULL").groupBy("id").agg((F.max(row) if overwrite else F.min(row)).alias("row"))
        self.seq += 1
        batch = single.select(F.lit(self.seq).cast("long").alias("seq"), F.lit("o" if overwrite else "i").alias("op"), "id", "row.tag", "row.vector")
        known = self._logged().select("id").join(oplog.keys_of(batch, "id", measured["n"]), "id", "left_semi").select("id", F.lit(True).alias("known"))
        outcome = F.lit("SUCCESS") if overwrite else F.when(F.col("known"), "DUPLICATED_ENTRY").otherwise("SUCCESS")
        done = single.select("id").join(known, "id", "left").select("id", outcome.alias("outcome"))
        done = done.union(marked.where("fault IS NOT NULL").select("id", F.col("fault").alias("outcome")))
        if mode == ImportMode.IGNORE_VERBOSE and (n := done.where("outcome = 'DUPLICATED_ENTRY'").count()):
            warnings.warn(f"{n} ids were there already and are left alone", stacklevel=2)
        self._append(batch, measured["n"])
        return done

    # Search

    def search(self, vector: Sequence[float], k: int = 1, tag: int = 0, pad: bool = False, strict: bool = False) -> DataFrame:
        """The k best rows. Type HNSW reads cells of the snapshot: first the nearest ones, whose number
        and breadth the parameters give, then all that may hold a nearer row; with a tag, all rows."""
        began = time.monotonic()
        self._check_vector(vector)
        if self.type is IndexType.HNSW_INDEX and tag == 0:
            rows = self._near(vector, k)
        else:
            rows = self.state()
            if strict and rows.isEmpty():
                raise IndexEmpty()
        found = search.knn(rows, vector, k, self.method, tag, pad, self.dims)
        self._timed("search", began)
        return found

    def _near(self, vector: Sequence[float], k: int) -> DataFrame:
        """Rows of all cells that may hold one of the k best, and all rows that were changed since the
        cells were made. The k-th distance within the nearest cells tells which these are."""
        if self.cells is None:
            if self.began_empty or self.snapshot.isEmpty():
                return self.state()
            self.cells = CellIndex.for_table(self.snapshot, self.params)
        best = search.knn(self._changed(self.cells.near(vector, k, self.method, self.params)), vector, k, self.method, dims=self.dims)
        worst = F.max("distance") if self.method.smaller_is_better else F.min("distance")
        seen = best.where(~F.isnan("distance")).agg(F.count("*").alias("n"), worst.alias("worst")).first()
        if seen["n"] < k:
            return self.state()
        return self._changed(self.cells.within(vector, self.method, seen["worst"]))

    def _changed(self, near: DataFrame) -> DataFrame:
        """Some rows of the snapshot, and all rows of the log and the buffer."""
        near = near.select("id", "tag", "vector")
        if self.log is not None:
            near = oplog.state(self.snapshot, self.log, self.changes, "id", ["tag", "vector"], "tag", near)
        return self._overlaid(near)

    def search_batch(self, queries: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
        return search.knn_batch(self.state(), queries, k, self.method, exclude_self)

    def filter_subset(self, ids: Sequence[int], vector: Sequence[float], k: int, pad: bool = False) -> DataFrame:
        return search.filter_subset(self.state(), ids, vector, k, self.method, pad, self.dims)

    def kmeans_centroids(self, k: int, **options) -> VectorTable:
        return VectorTable(self.spark, self.dims, Method.L2NORM, snapshot=kmeans.centroids(self.state(), k, **options))

    # Parameters and persistence

    def update_context(self, **params: int) -> None:
        """``ef_search`` holds from the next search on, the others from the next building of cells."""
        if self.type is IndexType.FLAT_INDEX:
            raise NotImplemented_()
        known = {k: v for k, v in params.items() if k in self.params}
        if {"ef_construct", "M0"} & known.keys():
            self.cells = None
        self.params |= known

    def _meta(self, kind: str) -> dict:
        return {"kind": kind, "type": self.name, "method": self.method.name, "dims": self.dims, "params": self.params}

    def save(self, path: str) -> None:
        began = time.monotonic()
        store.save(self.state(), path, self._meta("table"))
        self._timed("dump", began)

    def export(self, path: str) -> None:
        store.save(self.state(), path, self._meta("vectors"))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorTable:
        rows, meta = store.load(spark, path, ("table",))
        table = cls(spark, meta["dims"], meta["method"], IndexType.FLAT_INDEX if meta["type"] == "flat" else IndexType.HNSW_INDEX, rows)
        table.params |= meta["params"]
        return table

    def import_path(self, path: str, mode: ImportMode | int = ImportMode.IGNORE) -> DataFrame:
        return self.import_rows(store.load(self.spark, path, ("table", "vectors"))[0], mode)

    @classmethod
    def load_binary(cls, spark: SparkSession, path: str) -> VectorTable:
        """A table from files of the older binary format, which must agree on method and dims."""
        heads = store.vector_headers(spark, path).select("magic", "method", "dims").distinct().limit(2).collect()
        if len(heads) != 1:
            raise InvalidDimensions("the files differ, or there is none")
        kind = IndexType.HNSW_INDEX if heads[0]["magic"] == store.GRAPH_MAGIC else IndexType.FLAT_INDEX
        return cls(spark, heads[0]["dims"], heads[0]["method"], kind, store.read_vector_files(spark, path))

    def import_binary(self, path: str, mode: ImportMode | int = ImportMode.IGNORE) -> DataFrame:
        return self.import_rows(store.read_vector_files(self.spark, path), mode)
