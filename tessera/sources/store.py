"""Sources and sinks: Parquet tables with a line of metadata, and the older binary files.

A saved table is a folder with ``rows`` (Parquet) and ``meta`` (one line of JSON), both written by
Spark, so any store that Spark knows will do.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.types import FileIOError, InvalidFile

# Fixed values of the binary formats.
VECTORS_MAGIC, FLAT_MAGIC, GRAPH_MAGIC, KV_MAGIC = 0x464C5000, 0x464C5449, 0x484E5357, 0x4B565354
#: magic, version (3), header size, elements, method, dims, only vectors, aligned dims, bytes of a
#: vector, bytes of a node, offset of vectors, offset of nodes
VECTOR_HEADER = struct.Struct("<I4BI6H2Q")
KV_HEADER = struct.Struct("<I8xI")
KV_ENTRY = struct.Struct("<QII")


def save(rows: DataFrame, path: str, meta: dict) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/rows")
    rows.sparkSession.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load(spark: SparkSession, path: str, kinds: tuple[str, ...]) -> tuple[DataFrame, dict]:
    meta = read_meta(spark, path)
    if meta.get("kind") not in kinds:
        raise InvalidFile(f"{meta.get('kind')} where {' or '.join(kinds)} should be")
    return spark.read.parquet(f"{path}/rows"), meta


def read_meta(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/meta").first()["value"])


def inspect(spark: SparkSession, path: str) -> DataFrame:
    """The metadata of a saved table as ``field``, ``value``."""
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in sorted(read_meta(spark, path).items())], "field string, value string")


def vector_header(data: bytes) -> dict:
    if len(data) < VECTOR_HEADER.size:
        raise InvalidFile("too short")
    names = ("magic", "major", "minor", "patch", "header_size", "elements", "method", "dims", "only_vectors", "dims_aligned", "vector_size", "node_size", "vector_offset", "node_offset")
    found = dict(zip(names, VECTOR_HEADER.unpack_from(data), strict=True))
    if found["magic"] not in (VECTORS_MAGIC, FLAT_MAGIC, GRAPH_MAGIC):
        raise InvalidFile("another kind of file")
    if found["vector_size"] != 16 + 4 * found["dims_aligned"] or found["vector_offset"] + found["elements"] * found["vector_size"] > len(data):
        raise InvalidFile("offsets do not fit")
    return found


def read_vector_files(spark: SparkSession, path: str) -> DataFrame:
    """``id``, ``tag``, ``vector`` of binary vector files; a task reads one file whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                data = value.as_py()
                h = vector_header(data)
                row = np.dtype([("id", "<i8"), ("tag", "<i8"), ("vector", "<f4", (h["dims_aligned"],))])
                rows = np.frombuffer(data, row, h["elements"], h["vector_offset"])
                vectors = np.ascontiguousarray(rows["vector"][:, : h["dims"]])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, vectors.size + 1, h["dims"], dtype=np.int32)), pa.array(vectors.ravel()))
                yield pa.record_batch([pa.array(rows["id"]), pa.array(rows["tag"]), lists], ["id", "tag", "vector"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "id long, tag long, vector array<float>")


def vector_headers(spark: SparkSession, path: str) -> DataFrame:
    """The header of each binary vector file: ``path``, ``magic``, ``method``, ``dims``, ``elements``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [vector_header(v.as_py()) for v in batch.column(1)]
            yield pa.record_batch([batch.column(0), *(pa.array([h[c] for h in heads], pa.int64()) for c in ("magic", "method", "dims", "elements"))], ["path", "magic", "method", "dims", "elements"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, magic long, method long, dims long, elements long")


def write_vector_files(rows: DataFrame, path: str, method: int, dims: int) -> DataFrame:
    """``name``, ``content``: one binary vector file for each partition of ``rows``, as a Parquet
    table at ``path``; ``content`` is byte for byte a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        yield pa.record_batch([pa.array([f"vectors-{TaskContext.get().partitionId():05d}.bin"]), pa.array([vector_file(own, method, dims)], pa.binary())], ["name", "content"])

    rows.select("id", "tag", "vector").mapInArrow(run, "name string, content binary").write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def vector_file(rows: list[tuple[int, int, list[float]]], method: int, dims: int, magic: int = VECTORS_MAGIC) -> bytes:
    """The bytes of one vector file."""
    aligned = (dims + 3) // 4 * 4
    table = np.zeros(len(rows), np.dtype([("id", "<i8"), ("tag", "<i8"), ("vector", "<f4", (aligned,))]))
    for k, (id_, tag, vector) in enumerate(rows):
        table[k]["id"], table[k]["tag"] = id_, tag
        table[k]["vector"][:dims] = vector
    size = table.dtype.itemsize
    head = VECTOR_HEADER.pack(magic, 0, 0, 0, VECTOR_HEADER.size, len(rows), method, dims, 1, aligned, size, 0, VECTOR_HEADER.size, 0)
    return head + table.tobytes()


def parse_kv_file(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    if len(data) < KV_HEADER.size:
        raise InvalidFile("too short")
    magic, elements = KV_HEADER.unpack_from(data)
    index = np.frombuffer(data, "<u8", 2 * elements, KV_HEADER.size).reshape(-1, 2) if len(data) >= KV_HEADER.size + 16 * elements else None
    if magic != KV_MAGIC or index is None or (elements and int(index[0, 0]) != KV_HEADER.size + 16 * elements):
        raise InvalidFile("another kind of file")
    for offset, size in index.tolist():
        _, klen, vlen = KV_ENTRY.unpack_from(data, offset)
        if klen + vlen + KV_ENTRY.size > size or offset + size > len(data):
            raise InvalidFile("an entry does not fit")
        at = offset + KV_ENTRY.size
        yield data[at : at + klen], data[at + klen : at + klen + vlen]


def kv_file(rows: list[tuple[bytes, bytes]]) -> bytes:
    """The bytes of one key-value file; keys are hashed by XXH64 with seed 0."""
    import xxhash

    entries = [KV_ENTRY.pack(xxhash.xxh64_intdigest(k), len(k), len(v)) + k + v for k, v in rows]
    at, index = KV_HEADER.size + 16 * len(rows), b""
    for e in entries:
        index += struct.pack("<QQ", at, len(e))
        at += len(e)
    return KV_HEADER.pack(KV_MAGIC, len(rows)) + index + b"".join(entries)


def read_kv_files(spark: SparkSession, path: str) -> DataFrame:
    """``key``, ``value`` of binary key-value files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                pairs = list(parse_kv_file(value.as_py()))
                yield pa.record_batch([pa.array([k for k, _ in pairs], pa.binary()), pa.array([v for _, v in pairs], pa.binary())], ["key", "value"])

    return spark.read.format("binaryFile").load(path).select(F.col("content")).mapInArrow(run, "key binary, value binary")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share; what is written there goes when the
    application ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise FileIOError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file:///tmp/checkpoints"  # local mode alone, as in tests
    path = f"{base.rstrip('/')}/tessera-{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(where)
    files.deleteOnExit(where)
    return f"{path}/table"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
