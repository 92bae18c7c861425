"""Operator 5, line dedup with two Bloom filters.

A line's key is the line without ASCII white space at both ends, A-Z in lower case. A key of at
least ``min_chars`` code points that occurs in two documents or more loses its lines everywhere but
in the document with the smallest id.

1. Every task fills two Bloom filters from its documents: keys seen once, and keys seen again. They
   leave the task in chunks of 65,536 bits, as positions where that is shorter, and are merged
   chunk by chunk as a stream: a bit belongs to "seen twice" if one side has it there or both sides
   have it in "seen once". No repeated key is missed.
2. The merged second filter (at most ``MAX_BITS``, 64 MB) is broadcast. Only keys that it holds
   leave the tasks, once a document, as 128-bit digests; they are written to the shared folder.
3. Digests are grouped for exact confirmation and the smallest id (combined before the shuffle), and
   joined with the suspects again. Lines with more than one in ``HOT`` of all suspects, of which
   there are fewer than ``HOT``, are broadcast for that; so no line fills a task.
4. Documents meet their own lists of dropped digests in one join by id.

The filters get 24 bits a line, counted beforehand, up to ``MAX_BITS``, and never fewer than
``LEAST_BITS`` a line: where there are more lines, hashes are dealt into ranges, each with its own
pair of filters and its own pass over the texts (some 90 million lines a pass). Memory stays bounded
and filters stay selective; the passes grow with the corpus.

Defined results: a null or empty text is one empty line; rows that share an id count as one
document; rows with a null id neither lose lines nor count; texts of any length are read whole;
an empty input gives no rows; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import materialise

MIN_CHARS = 10
BITS_PER_LINE, LEAST_BITS = 24, 6
CHUNK = 1 << 16
MAX_BITS = 1 << 29
HOT = 1024
SPACE = b" \t\n\x0b\x0c\r"


def keys_of(text: str | None, min_chars: int) -> list[bytes | None]:
    """For each line its key, or None where it is too short."""
    keys: list[bytes | None] = []
    for line in (text or "").encode().lower().split(b"\n"):
        key = line.strip(SPACE)
        long = len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars)
        keys.append(key if long else None)
    return keys


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def positions(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each 64-bit hash."""
    return hashes % np.uint64(bits), ((hashes >> np.uint64(32)) | (hashes << np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) % np.uint64(bits)


def in_range(hashes: np.ndarray, ranges: int, own: int) -> np.ndarray:
    """Which hashes belong to a range; by other bits than their places in a filter."""
    if ranges == 1:
        return np.ones(len(hashes), bool)
    mixed = hashes * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(32)) % np.uint64(ranges) == own


class Filters:
    """Once-seen and twice-seen bits of one task, as bytes of 0 and 1 packed when they leave."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once = np.zeros(bits // 8, np.uint8)
        self.twice = np.zeros(bits // 8, np.uint8)

    @staticmethod
    def holds(filled: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for at in positions(hashes, bits):
            found &= (filled[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
        return found

    @staticmethod
    def put(filled: np.ndarray, hashes: np.ndarray, bits: int) -> None:
        for at in positions(hashes, bits):
            np.bitwise_or.at(filled, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def add(self, hashes: np.ndarray) -> None:
        """Hashes of some documents' keys, each document's only once."""
        each, count = np.unique(hashes, return_counts=True)
        self.put(self.twice, each[(count > 1) | self.holds(self.once, each, self.bits)], self.bits)
        self.put(self.once, each, self.bits)

    def chunks(self) -> Iterator[tuple[int, bytes, bytes]]:
        for k in range(self.bits // CHUNK):
            part = slice(k * CHUNK // 8, (k + 1) * CHUNK // 8)
            if self.once[part].any():
                yield k, pack_bits(self.once[part]), pack_bits(self.twice[part])


def pack_bits(dense: np.ndarray) -> bytes:
    at = np.flatnonzero(np.unpackbits(dense, bitorder="little"))
    return at.astype("<u2").tobytes() if len(at) < CHUNK // 16 else dense.tobytes()


def unpack_bits(data: bytes) -> np.ndarray:
    if len(data) == CHUNK // 8:
        return np.frombuffer(data, np.uint8)
    bits = np.zeros(CHUNK, np.uint8)
    bits[np.frombuffer(data, "<u2")] = 1
    return np.packbits(bits, bitorder="little")


def twice_seen(docs: DataFrame, bits: int, min_chars: int, ranges: int = 1, own: int = 0) -> np.ndarray:
    """The merged filter of one range of hashes; ``docs``: doc_id, text."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = Filters(bits)
        for batch in batches:
            hashes: list[int] = []
            for text in batch.column(1).to_pylist():
                hashes.extend(map(xxhash.xxh3_64_intdigest, set(keys_of(text, min_chars)) - {None}))
            found = np.array(hashes, np.uint64)
            filters.add(found[in_range(found, ranges, own)])
        for k, once, twice in filters.chunks():
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([once], pa.binary()), pa.array([twice], pa.binary())], ["chunk", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for k, once, twice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                once, twice = unpack_bits(once), unpack_bits(twice)
                if k not in held:
                    held[k] = [once.copy(), twice.copy()]
                else:
                    mine = held[k]
                    mine[1] |= twice | (mine[0] & once)
                    mine[0] |= once
        rows = [(k, twice.tobytes()) for k, (_, twice) in held.items() if twice.any()]
        yield pa.record_batch([pa.array([k for k, _ in rows], pa.int32()), pa.array([t for _, t in rows], pa.binary())], ["chunk", "twice"])

    local = docs.where("doc_id IS NOT NULL").mapInArrow(fill, "chunk int, once binary, twice binary")
    merged = local.repartition("chunk").mapInArrow(merge, "chunk int, twice binary")
    found = np.zeros(bits // 8, np.uint8)
    for row in merged.toLocalIterator():  # at most MAX_BITS, partition by partition
        found[row["chunk"] * CHUNK // 8 : (row["chunk"] + 1) * CHUNK // 8] = np.frombuffer(row["twice"], np.uint8)
    return found


def filter_size(docs: DataFrame) -> tuple[int, int]:
    """Bits of a filter, and the ranges of hashes."""
    text = F.coalesce("text", F.lit(""))
    lines = docs.agg(F.sum(F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1)).first()[0] or 1
    ranges = -(-lines * LEAST_BITS // MAX_BITS)
    return min(MAX_BITS, -(-lines * BITS_PER_LINE // ranges // CHUNK) * CHUNK), ranges


def suspected(docs: DataFrame, bits: int, min_chars: int, ranges: int, own: int) -> DataFrame:
    """``line`` (digest), ``doc_id`` of the keys that a range's second filter holds, once a document."""
    filled = docs.sparkSession.sparkContext.broadcast(twice_seen(docs, bits, min_chars, ranges, own))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = set(keys_of(text, min_chars)) - {None}
                ids.extend([doc_id] * len(found))
                keys.extend(found)
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
            hits = np.flatnonzero(Filters.holds(filled.value, hashes, bits) & in_range(hashes, ranges, own))
            yield pa.record_batch([pa.array([digest(keys[k]) for k in hits], pa.binary()), pa.array([ids[k] for k in hits], pa.int64())], ["line", "doc_id"])

    return docs.where("doc_id IS NOT NULL").mapInArrow(probe, "line binary, doc_id long")


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, bits: int | None = None, ranges: int = 1) -> DataFrame:
    """``doc_id``, ``drops``: the digests of the lines that a document loses. Exact."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not bits:
        bits, ranges = filter_size(chosen)
    parts = [materialise(suspected(chosen, bits, min_chars, ranges, own), "suspect-lines") for own in range(ranges)]
    suspects = reduce(DataFrame.union, parts)
    first = suspects.groupBy("line").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first < last").drop("last")
    first = materialise(first, "first-lines")
    many = suspects.count() // HOT
    # Lines with more than one in HOT of the suspects are fewer than HOT.
    hot = first.where(F.col("n") > many).select("line", F.col("first").alias("hot_first"))
    marked = suspects.join(F.broadcast(hot), "line", "left")
    rest = marked.where("hot_first IS NULL").select("line", "doc_id").join(first.where(F.col("n") <= many).drop("n"), "line")
    dropped = rest.where("doc_id > first").select("line", "doc_id").union(marked.where("doc_id > hot_first").select("line", "doc_id"))
    return dropped.groupBy("doc_id").agg(F.collect_set("line").alias("drops"))


def _rewritten(docs: DataFrame, drops: DataFrame, min_chars: int, digests: bool) -> DataFrame:
    """``docs``: id, text and whatever else; ``drops``: doc_id, drops. The columns of ``docs`` by
    their places (c0, c1, ...), so that their names never matter, with the kept text in the second's
    place, then ``lines`` and ``dropped``."""
    docs = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    drops = drops.select(F.col("doc_id").alias("c0"), "drops").hint("shuffle_hash")
    known = docs.where("c0 IS NOT NULL").join(drops, "c0", "left").select(*docs.columns, "drops")
    both = known.union(docs.where("c0 IS NULL").withColumn("drops", F.lit(None).cast("array<binary>")))
    schema = T.StructType([*docs.schema.fields, T.StructField("lines", T.LongType()), T.StructField("dropped", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, dropped, kept = [], [], []
            for text, gone in zip(batch.column(1).to_pylist(), batch.column("drops").to_pylist(), strict=True):
                text = text or ""
                own = text.split("\n")
                lines.append(len(own))
                if gone:
                    gone = set(gone)
                    left = [line for line, key in zip(own, keys_of(text, min_chars), strict=True) if key is None or digest(key) not in gone]
                    dropped.append(len(own) - len(left))
                    text = "\n".join(left)
                else:
                    dropped.append(0)
                kept.append(hashlib.sha256(text.encode()).hexdigest() if digests else text)
            columns = batch.columns[:-1]
            columns[1] = pa.array(kept, pa.string())
            yield pa.record_batch([*columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], schema.names)

    return both.mapInArrow(run, schema)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with ``text`` without the dropped lines; an ``n_chars`` column follows it."""
    others = [c for c in docs.columns if c != "text"]
    inner = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *(F.col(f"`{c}`") for c in others))
    done = _rewritten(inner, repeated_lines(docs, min_chars), min_chars, digests=False)
    place = {c: f"c{k + 2}" for k, c in enumerate(others)} | {"text": "c1"}
    columns = [F.length("c1").cast(docs.schema[c].dataType) if c == "n_chars" else F.col(place[c]) for c in docs.columns]
    return done.select(*(column.alias(c) for column, c in zip(columns, docs.columns, strict=True)))


def digest_documents(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    done = _rewritten(docs.select(F.col("doc_id").cast("long"), F.col("text")), repeated_lines(docs, min_chars), min_chars, digests=True)
    return done.select(F.col("c0").alias("doc_id"), F.col("lines").alias("n_lines"), F.col("dropped").alias("n_dropped"), F.col("c1").alias("kept_sha256"))
