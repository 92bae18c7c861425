"""Operator 4, WARC archives under Zstandard with a dictionary.

An archive begins with a skippable frame that holds a dictionary; every record is one frame of its
own. ``write_archives`` gives a table of archives, ``read_archives`` loads the dictionary from the
leading frame, decodes frame by frame and checks headers, lengths and digests; whatever is wrong
raises ``ValueError``. Archives are rows of a table (``data`` is byte for byte a ``.warc.zst``
file), so that Spark's own commit makes them whole and any store that Spark knows can hold them.

Of records with equal payloads of at least ``MIN_PAYLOAD`` bytes, the one with the smallest page id
is the response and the others are revisits of it, which carry the HTTP head alone. Digests are
grouped with sums before the shuffle and joined once, by a key that spreads payloads too short to
count; a hot payload is split by the adaptive join.

Each task starts a new archive after ``ARCHIVE_BYTES`` of records. Its dictionary is trained on the
archive's first ``DICTIONARY_SAMPLES`` records, a bound that touches sizes only, never results.

Defined results: a null html is the empty payload; a null url becomes ``urn:none``; control
characters and spaces of a url are percent-encoded; a null page id is larger than any other, and
where all ids of a group are null they are all responses; rows that share the smallest id are all
responses; other columns are ignored; an empty input gives no archives.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_PAYLOAD = 100
ARCHIVE_BYTES = 16 << 20
DICTIONARY_SAMPLES = 256
DICTIONARY_BYTES = 32 << 10
LEVEL = 3
#: Records carry no time of their own.
DATE = "2000-01-01T00:00:00Z"
# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(ident: str) -> int | None:
    m = re.fullmatch(r"<urn:page:(none|-?\d+)>", ident)
    if not m:
        raise ValueError("a record id of another kind")
    return None if m[1] == "none" else int(m[1])


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    uri = UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else "urn:none"
    lines = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is None:
        block += payload
    else:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + "\r\n".join(lines).encode() + END + block + END


def build_archive(records: list[bytes]) -> bytes:
    samples = records[:DICTIONARY_SAMPLES]
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their bytes serve as they are
        trained = b"".join(samples)[:DICTIONARY_BYTES]
    coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(trained), write_checksum=True, write_content_size=True)
    stored = zstandard.ZstdCompressor(level=LEVEL).compress(trained)
    return b"".join([struct.pack("<II", DICTIONARY_MAGIC, len(stored)), stored, *map(coder.compress, records)])


def load_dictionary(data: bytes) -> tuple[zstandard.ZstdCompressionDict, int]:
    """The dictionary of the leading frame, plain or itself compressed, and where records begin."""
    if len(data) < 8:
        raise ValueError("the archive is too short")
    magic, size = struct.unpack_from("<II", data)
    if magic != DICTIONARY_MAGIC or 8 + size > len(data):
        raise ValueError("no dictionary frame leads the archive")
    content = data[8 : 8 + size]
    if content[:4] == struct.pack("<I", FRAME_MAGIC):
        content = zstandard.ZstdDecompressor().decompress(content)
    return zstandard.ZstdCompressionDict(content), 8 + size


def frame_end(data: bytes, at: int) -> int:
    """Where the frame at ``at`` ends, from its block headers."""
    if len(data) < at + 5 or struct.unpack_from("<I", data, at)[0] != FRAME_MAGIC:
        raise ValueError("no frame where a record should be")
    flags = data[at + 4]
    at += zstandard.frame_header_size(data[at : at + 18])
    while True:
        if at + 3 > len(data):
            raise ValueError("a frame is cut short")
        head = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            break
    at += 4 * (flags >> 2 & 1)
    if at > len(data):
        raise ValueError("a frame is cut short")
    return at


def _fields(lines: bytes) -> dict[str, str]:
    found = {}
    for line in lines.decode().split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon or not name:
            raise ValueError("a header line without a name")
        found[name.strip().lower()] = value.strip()
    return found


def parse_record(record: bytes) -> dict:
    """The record's fields, checked."""
    head, gap, rest = record.partition(END)
    if not head.startswith(VERSION) or not gap:
        raise ValueError("no WARC/1.1 head")
    fields = _fields(head[len(VERSION) :])
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"{name} is missing")
    if not fields["content-length"].isdecimal() or len(rest) != int(fields["content-length"]) + len(END) or not rest.endswith(END):
        raise ValueError("Content-Length does not fit the block")
    kind = fields["warc-type"]
    if kind not in ("response", "revisit"):
        raise ValueError("a record of another type")
    status, gap, payload = rest[: -len(END)].partition(END)
    first, _, http = status.partition(b"\r\n")
    if not first.startswith(b"HTTP/1.1 ") or not gap:
        raise ValueError("the block is no HTTP response")
    stated = _fields(http).get("content-length", "")
    scheme, _, digest = fields.get("warc-payload-digest", "").partition(":")
    if scheme != "sha256" or not re.fullmatch(r"[0-9a-f]{64}", digest) or not stated.isdecimal():
        raise ValueError("no payload digest or length")
    if kind == "response" and (len(payload) != int(stated) or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("the payload does not fit its length or digest")
    if kind == "revisit" and (payload or fields.get("warc-profile") != REVISIT_PROFILE or "warc-refers-to" not in fields):
        raise ValueError("not a revisit by payload digest")
    return {"page_id": page_of(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "payload_bytes": int(stated), "payload_digest": digest, "record_type": kind, "refers_to": page_of(fields["warc-refers-to"]) if kind == "revisit" else None, "payload": payload if kind == "response" else None}


def read_archive(data: bytes) -> Iterator[dict]:
    dictionary, at = load_dictionary(data)
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(data):
        end = frame_end(data, at)
        try:
            record = decoder.decompress(data[at:end])
        except zstandard.ZstdError as e:
            raise ValueError("a frame cannot be decoded") from e
        yield parse_record(record)
        at = end


def mark_revisits(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``html``, ``digest`` and ``refers_to`` (null: a response)."""
    html = F.coalesce("html", F.lit(""))
    chosen = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha2(html, 256).alias("digest"))
    long = F.octet_length("html") >= MIN_PAYLOAD
    first = chosen.where(long).groupBy(F.col("digest").alias("key")).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    keyed = chosen.withColumn("key", F.when(long, F.col("digest")).otherwise(F.concat_ws("-", F.lit("short"), F.col("page_id").cast("string"), F.xxhash64("url").cast("string"))))
    joined = keyed.join(first.hint("shuffle_hash"), "key", "left")
    later = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    return joined.select("page_id", "url", "html", "digest", F.when(later, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """A row for each archive: ``records``, ``data``. Write it uncompressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def archive(records: list[bytes]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([len(records)], pa.int64()), pa.array([build_archive(records)], pa.binary())], ["records", "data"])

        records, size = [], 0
        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                records.append(build_record(page_id, url, html.encode(), digest, refers_to))
                size += len(records[-1])
                if size >= archive_bytes:
                    yield archive(records)
                    records, size = [], 0
        if records:
            yield archive(records)

    return mark_revisits(pages).mapInArrow(run, "records long, data binary")


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """A row for each record of the archives in ``data``."""
    types = {"page_id": "long", "url": "string", "payload_bytes": "long", "payload_digest": "string", "record_type": "string", "refers_to": "long"} | ({"payload": "binary"} if payloads else {})
    arrow = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for row in read_archive(data.as_py()):
                    rows.append(row)
                    if len(rows) == 1000:
                        yield table(rows)
                        rows = []
                yield table(rows)

    def table(rows: list[dict]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[c] for r in rows], arrow[t]) for c, t in types.items()], list(types))

    return archives.select("data").mapInArrow(run, ", ".join(f"{c} {t}" for c, t in types.items()))
