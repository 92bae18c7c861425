"""The key-value table: byte keys and values as a snapshot plus a log of puts and deletions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import oplog
from tessera.sources import store
from tessera.table import BUFFERED, MOST_BATCHES
from tessera.types import KV_SCHEMA, InvalidArgument, KVInvalidKey, KVInvalidTable, KVInvalidValue, KVKeyNotFound

#: This pattern alone means all keys.
ALL = b"*"


def prefix_filter(key: Column, prefix: bytes) -> Column:
    return F.lit(True) if prefix == ALL else F.startswith(key, F.lit(bytearray(prefix)))


class KVTable:
    """Single changes stay in a bounded buffer of the driver; see ``VectorTable``."""

    def __init__(self, spark: SparkSession, name: str | None = None, snapshot: DataFrame | None = None):
        if name is not None and len(name) > 150:
            raise InvalidArgument("the name is too long")
        self.spark, self.name, self.seq = spark, name or "table", 0
        self._snapshot = spark.createDataFrame([], KV_SCHEMA) if snapshot is None else snapshot.select("key", "value")
        self.began_empty = snapshot is None
        self.log: DataFrame | None = None
        self.changes = self.batches = 0
        self.buffer: dict[bytes, bytes | None] = {}

    @property
    def snapshot(self) -> DataFrame:
        if self._snapshot is None:
            raise KVInvalidTable("the table was destroyed")
        return self._snapshot

    def destroy(self) -> None:
        """Gives up all rows; every later use raises ``KVInvalidTable``. Saved copies stay."""
        self._snapshot = self.log = None
        self.buffer = {}

    def __enter__(self) -> KVTable:
        return self

    def __exit__(self, *_) -> None:
        self.destroy()

    def state(self) -> DataFrame:
        rows = self.snapshot if self.log is None else oplog.state(self.snapshot, self.log, self.changes, "key", ["value"])
        if not self.buffer:
            return rows
        keys = self.spark.createDataFrame([(bytearray(k),) for k in self.buffer], "key binary")
        live = self.spark.createDataFrame([(bytearray(k), bytearray(v)) for k, v in self.buffer.items() if v is not None], KV_SCHEMA)
        return rows.join(F.broadcast(keys), "key", "left_anti").select("key", "value").union(live)

    def _append(self, rows: DataFrame, changes: int) -> None:
        self.log = rows if self.log is None else self.log.union(rows)
        self.changes += changes
        self.batches += 1
        if self.batches >= MOST_BATCHES:
            path = store.scratch(self.spark, "kv-snapshot")
            self.state().write.parquet(path)
            self._snapshot, self.log, self.changes, self.batches, self.began_empty = self.spark.read.parquet(path), None, 0, 0, False

    def _hold(self, key: bytes, value: bytes | None) -> None:
        self.buffer[bytes(key)] = value
        if len(self.buffer) >= BUFFERED:
            self.flush()

    def flush(self) -> None:
        """The buffered changes become one batch of the log."""
        if self.buffer:
            self.seq += 1
            rows = [(self.seq, "d" if v is None else "o", bytearray(k), None if v is None else bytearray(v)) for k, v in self.buffer.items()]
            self.buffer = {}
            self._append(self.spark.createDataFrame(rows, "seq long, op string, key binary, value binary"), len(rows))

    def put(self, key: bytes, value: bytes) -> None:
        if not key:
            raise KVInvalidKey()
        if not value:
            raise KVInvalidValue()
        self.snapshot  # noqa: B018 - a destroyed table raises
        self._hold(key, bytes(value))

    def put_batch(self, rows: DataFrame) -> None:
        """``key``, ``value``, ``seq`` (order within the batch); empty keys and values are left out."""
        self.flush()
        good = rows.where((F.octet_length("key") > 0) & (F.octet_length("value") > 0))
        good = good.select((F.col("seq") + self.seq).alias("seq"), F.lit("o").alias("op"), F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"))
        measured = rows.agg(F.max("seq").alias("last"), F.count("*").alias("n")).first()
        self.seq += measured["last"] or 0
        self._append(good, measured["n"])

    def delete(self, key: bytes) -> None:
        self.get(key)
        self._hold(key, None)

    def get(self, key: bytes) -> bytes:
        if not key:
            raise KVInvalidKey()
        if key in self.buffer:
            value = self.buffer[key]
        elif self.began_empty and self.log is None:
            self.snapshot  # noqa: B018 - a destroyed table raises
            value = None
        else:
            where = F.col("key") == F.lit(bytearray(key))
            rows = self.snapshot.where(where)
            if self.log is not None:
                rows = oplog.fold(oplog.as_log(rows, "key", ["value"]).union(self.log.where(where)), "key", ["value"])
            row = rows.select("value").first()
            value = None if row is None else bytes(row["value"])
        if value is None:
            raise KVKeyNotFound()
        return value

    def get_batch(self, keys: DataFrame) -> DataFrame:
        """``key``, ``value`` (null: not there) of ``keys``."""
        return keys.select(F.col("key").cast("binary").alias("key")).join(self.state(), "key", "left")

    def prefix_scan(self, prefix: bytes, limit: int | None = None) -> DataFrame:
        """``key``, ``value``, ``klen``, ``vlen`` in the order of keys."""
        found = self.state().where(prefix_filter(F.col("key"), prefix)).select("key", "value", F.octet_length("key").alias("klen"), F.octet_length("value").alias("vlen")).orderBy("key")
        return found if limit is None else found.limit(limit)

    def count(self) -> DataFrame:
        """The number of rows, as one row ``n``."""
        return self.state().agg(F.count("*").alias("n"))

    def size(self) -> int:
        return self.count().first()["n"]

    def save(self, path: str) -> None:
        store.save(self.state(), path, {"kind": "kv", "name": self.name})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> KVTable:
        rows, meta = store.load(spark, path, ("kv",))
        return cls(spark, meta["name"], rows)

    @classmethod
    def load_binary(cls, spark: SparkSession, path: str, name: str | None = None) -> KVTable:
        """A table from files of the older binary format."""
        return cls(spark, name, store.read_kv_files(spark, path))
