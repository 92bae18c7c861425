"""The kernel of batches of queries: what it holds at a time, and ties by rounding."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from tessera.operators import search
from tessera.types import Method


def batch_of(ids, vectors):
    places = pa.array(np.arange(0, vectors.size + 1, vectors.shape[1], dtype=np.int32))
    return pa.record_batch([pa.array(ids), pa.ListArray.from_arrays(places, pa.array(vectors.ravel()))], ["id", "vector"])


def run(ids, vectors, queries, k, method, exclude_self=False):
    kernel = search._kernel(SimpleNamespace(value=queries), k, method, exclude_self)
    return sorted(row for b in kernel(iter([batch_of(ids, vectors)])) for row in zip(*(c.to_pylist() for c in b.columns), strict=True))


@pytest.mark.parametrize("method", list(Method))
def test_memory_is_that_of_a_block(method):
    rng = np.random.default_rng(2)
    vectors, ids = rng.standard_normal((10_000, 16)).astype(np.float32), np.arange(1, 10_001)
    tracemalloc.start()
    found = run(ids, vectors, (ids[:1024], vectors[:1024]), 10, method)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 10 * 1024 and peak < 100e6


def test_rows_that_tie_by_rounding_only():
    """Of 320 rows at 0.5 after rounding the smallest ids win, however many are nearer before it."""
    ids = np.arange(1, 321)
    vectors = (0.5 + (7 - (ids - 1) // 40) * 2.0**-24)[:, None].astype(np.float32)
    assert run(ids, vectors, (np.array([9]), np.zeros((1, 1), np.float32)), 3, Method.L2NORM) == [(9, 1, 0.5), (9, 2, 0.5), (9, 3, 0.5)]


@pytest.mark.parametrize("method", list(Method))
def test_copies_zeros_and_the_query_itself(method):
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((5000, 3)).astype(np.float32)
    vectors[::3], vectors[1::7] = vectors[0], 0
    ids = rng.permutation(5000) + 1
    sign = 1 if method.smaller_is_better else -1
    wide, want = vectors.astype(np.float64), []
    for i, q in zip(ids[:30], wide[:30], strict=True):
        product, scale = (wide * q).sum(1), np.sqrt((wide * wide).sum(1)) * np.sqrt((q * q).sum())
        d = {Method.L2NORM: np.sqrt(((wide - q) ** 2).sum(1)), Method.DOTP: product, Method.COSINE: np.divide(product, scale, out=np.zeros(5000), where=scale > 0)}[method]
        best = sorted((sign * x, int(j)) for x, j in zip(np.round(d, 6), ids, strict=True) if j != i)[:10]
        want += [(int(i), j, sign * x + 0.0) for x, j in best]
    assert run(ids, vectors, (ids[:30], vectors[:30]), 10, method, True) == sorted(want)
