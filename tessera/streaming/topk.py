"""A running top-k as a Structured Streaming sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.search import best_first
from tessera.types import Method


class StreamingTopK:
    """Folds each micro-batch of (``id``, ``distance``) into a Parquet state of at most k rows.

    A batch writes the state of its number and reads that of the number before, so that a batch
    which runs again writes the same state once more.
    """

    def __init__(self, spark: SparkSession, path: str, k: int, method: Method | str | int):
        self.spark, self.path, self.k, self.method = spark, path.rstrip("/"), k, Method.of(method)
        self.last: int | None = None

    def fold(self, batch: DataFrame, number: int) -> None:
        rows = batch.select("id", "distance")
        if number > 0:
            rows = rows.union(self.spark.read.schema(rows.schema).parquet(f"{self.path}/state-{number - 1}"))
        rows.orderBy(*best_first(self.method)).limit(self.k).write.mode("overwrite").parquet(f"{self.path}/state-{number}")
        self.last = number

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.fold).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def result(self) -> DataFrame:
        state = self.spark.read.parquet(f"{self.path}/state-{self.last}")
        return state.orderBy(*best_first(self.method))
