"""A running top-k over batches of (``id``, ``distance``)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessera.operators.search import best_first
from tessera.types import InvalidArgument, Method


class TopK:
    """Keeps the best ``n`` rows of all batches; ``n`` of -1 keeps and sorts them all. Of equal
    distances the smaller id is better; ids are not made unique."""

    def __init__(self, n: int, method: Method | str | int):
        if n == 0 or n < -1:
            raise InvalidArgument("n")
        self.n, self.method = n, Method.of(method)
        self.state: DataFrame | None = None

    def update(self, batch: DataFrame) -> TopK:
        batch = batch.select("id", "distance")
        both = batch if self.state is None else self.state.union(batch)
        self.state = both if self.n == -1 else both.orderBy(*best_first(self.method)).limit(self.n)
        return self

    def close(self, n: int | None = None) -> DataFrame:
        """The best ``n`` (all that are held, by default), best first; the state is given up."""
        if self.state is None:
            raise InvalidArgument("no batch was given")
        state, self.state = self.state.orderBy(*best_first(self.method)), None
        return state if n is None else state.limit(n)


def merge(parts: list[DataFrame], k: int, method: Method | str | int) -> DataFrame:
    """The k best of several partial results."""
    top = TopK(k, method)
    for part in parts:
        top.update(part)
    return top.close()
