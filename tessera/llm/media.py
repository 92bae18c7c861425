"""Operator 2, media columns: texts as progressive JPEG pictures and RGB tensors.

``encode_media`` gives each row's picture, ``decode_media`` reads pictures back into tensors and
payloads, and ``digest_media`` reads them back and keeps digests and features. ``digest_documents``
writes the pictures as a media column in the shared folder and digests what it reads from there; the
tensors of a task's pictures are made one by one and not written, as they are twice as large as the
texts.

A payload is the text in UTF-8, filled with bytes 255 up to a positive multiple of 576. How it is
stored without loss: see ``jpeg``. Features come from the decoded full-resolution tensor: size,
mean and deviation of each colour, and a 64-bit hash of brightness over an 8 x 8 grid.

Defined results: a null text is the empty one (576 bytes 255); texts of any length are stored whole,
up to 6 GB; equal texts have equal values; repeated rows and null ids stay; other columns are
ignored; an empty input gives no rows; a stream that is no such picture raises ``ValueError``.
No shuffle; a task holds one tensor at a time.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import jpeg
from tessera.llm.common import materialise

UNIT = 576


def payload_of(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode()
    return len(data), data + b"\xff" * (UNIT if not data else -len(data) % UNIT)


def features(rgb: np.ndarray) -> str:
    """Whole-number sums, so that the text doesn't depend on the order of adding."""
    height, width, _ = rgb.shape
    flat = rgb.reshape(-1, 3)
    n = len(flat)
    sums = flat.sum(0, dtype=np.int64)
    squares = [int(np.dot(v := flat[:, k].astype(np.float64), v)) for k in range(3)]
    means = [int(s) / n for s in sums]
    deviations = [max(q / n - m * m, 0.0) ** 0.5 for q, m in zip(squares, means, strict=True)]
    rows, columns = np.arange(9) * height // 8, np.arange(9) * width // 8
    bright = np.add.reduceat(np.add.reduceat(rgb.sum(2, dtype=np.int64), rows[:-1], 0), columns[:-1], 1)
    bits = (bright > bright.mean()).ravel()
    mean, deviation = (",".join(f"{x:.3f}" for x in xs) for xs in (means, deviations))
    return f"{width}x{height};mean={mean};std={deviation};hash={np.packbits(bits).tobytes().hex()}"


def encode_media(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    chosen = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                payloads = [payload_of(t) for t in part.column(1).to_pylist()]
                media = pa.array([jpeg.encode_payload(p) for _, p in payloads], pa.binary())
                yield pa.record_batch([part.column(0), pa.array([n for n, _ in payloads], pa.int64()), media], ["doc_id", "n_bytes", "media"])

    return chosen.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def decode_media(media: DataFrame) -> DataFrame:
    """``rgb``: height x width x 3 bytes, row by row; ``payload``: the bytes stored."""
    schema = "doc_id long, height int, width int, rgb binary, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                picture = jpeg.decode(row.column(1)[0].as_py())
                rgb = jpeg.to_rgb(picture)
                yield pa.record_batch([row.column(0), pa.array([rgb.shape[0]], pa.int32()), pa.array([rgb.shape[1]], pa.int32()), pa.array([rgb.tobytes()], pa.binary()), pa.array([jpeg.read_payload(picture)], pa.binary())], ["doc_id", "height", "width", "rgb", "payload"])

    return media.select("doc_id", "media").mapInArrow(run, schema)


def digest_media(media: DataFrame) -> DataFrame:
    """``media``: doc_id, n_bytes, media, as ``encode_media`` gives them."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def digest(stored: bytes) -> tuple:
        picture = jpeg.decode(stored)
        back = jpeg.read_payload(picture)
        return len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), features(jpeg.to_rgb(picture))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [digest(stored.as_py()) for stored in batch.column(2)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
            yield pa.record_batch([*batch.columns[:2], *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def digest_documents(docs: DataFrame) -> DataFrame:
    return digest_media(materialise(encode_media(docs), "media"))
