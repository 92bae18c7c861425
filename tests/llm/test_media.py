"""Operator 2: exact round trips, and the general decoder against a plain encoder of its own."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from tessera.llm import jpeg, media


class Writer:
    """Bits as text; every table has 8-bit codes, one for each symbol in order."""

    def __init__(self):
        self.bits = []

    def code(self, symbol, symbols):
        self.bits.append(f"{symbols.index(symbol):08b}")

    def value(self, v, size):
        if size:
            self.bits.append(f"{v if v > 0 else v + (1 << size) - 1:0{size}b}")

    def bytes(self):
        text = "".join(self.bits)
        text += "1" * (-len(text) % 8)
        return int("1" + text, 2).to_bytes(len(text) // 8 + 1, "big")[1:] if text else b""


ALL = bytes(range(0xF0 + 11))


def plain_progressive(blocks, width, height):
    """One component; blocks (n, 64) in zigzag order. DC and AC, each with one refinement."""
    out = [b"\xff\xd8", jpeg._segment(jpeg.DQT, b"\0" + bytes(range(1, 65))), jpeg._segment(jpeg.SOF2, struct.pack(">BHHB", 8, height, width, 1) + bytes([1, 0x11, 0]))]
    counts = bytes([0] * 7 + [len(ALL)] + [0] * 8)
    out += [jpeg._segment(jpeg.DHT, bytes([k]) + counts + ALL) for k in (0x00, 0x10)]
    size_of = lambda v: abs(v).bit_length()
    shifted = lambda v: (abs(v) >> 1) * (1 if v > 0 else -1)
    w, last = Writer(), 0
    for b in blocks:
        gap = (int(b[0]) >> 1) - last
        last += gap
        w.code(size_of(gap), ALL)
        w.value(gap, size_of(gap))
    out.append(jpeg._scan([(1, 0)], 0, 0, 0, 1, w.bytes()))
    for first, end in ((1, 9), (10, 63)):
        w = Writer()
        for b in blocks:
            run = 0
            top = max([k for k in range(first, end + 1) if shifted(int(b[k]))], default=first - 1)
            for k in range(first, top + 1):
                v = shifted(int(b[k]))
                if not v:
                    run += 1
                    continue
                while run > 15:
                    w.code(0xF0, ALL)
                    run -= 16
                w.code(run << 4 | size_of(v), ALL)
                w.value(v, size_of(v))
                run = 0
            if top < end:
                w.code(0, ALL)
        out.append(jpeg._scan([(1, 0)], first, end, 0, 1, w.bytes()))
    w = Writer()
    for b in blocks:
        w.bits.append(str(int(b[0]) & 1))
    out.append(jpeg._scan([(1, 0)], 0, 0, 1, 0, w.bytes()))
    w = Writer()
    for b in blocks:
        values = [int(x) for x in b]
        new = [k for k in range(1, 64) if abs(values[k]) == 1]
        k = 1
        for target in new:
            zeros, pending = 0, []
            while k < target:
                if abs(values[k]) > 1:
                    pending.append(str(abs(values[k]) & 1))
                else:
                    zeros += 1
                    if zeros == 16:
                        w.code(0xF0, ALL)
                        w.bits += pending
                        zeros, pending = 0, []
                k += 1
            w.code(zeros << 4 | 1, ALL)
            w.bits.append("1" if values[target] > 0 else "0")
            w.bits += pending
            k = target + 1
        w.code(0, ALL)
        w.bits += [str(abs(values[j]) & 1) for j in range(k, 64) if abs(values[j]) > 1]
    out.append(jpeg._scan([(1, 0)], 1, 63, 1, 0, w.bytes()))
    return b"".join(out) + b"\xff\xd9"


@pytest.mark.parametrize("seed", range(6))
def test_decoder_on_sparse_pictures(seed):
    rng = np.random.default_rng(seed)
    width, height = int(rng.integers(1, 40)), int(rng.integers(1, 40))
    n = -(-width // 8) * -(-height // 8)
    blocks = np.where(rng.random((n, 64)) < 0.25, rng.integers(-40, 41, (n, 64)), 0)
    blocks[:, 0] = rng.integers(-300, 300, n)
    picture = jpeg.decode(plain_progressive(blocks, width, height))
    assert (picture.components[0].coefficients == blocks).all()
    rgb = jpeg.to_rgb(picture)
    assert rgb.shape == (height, width, 3)
    # The transform by its definition, one sample.
    k, x = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    basis = np.cos((2 * x + 1) * k * np.pi / 16) / 2 * np.where(k == 0, 2**-0.5, 1)
    square = np.zeros(64)
    square[jpeg.ZIGZAG] = blocks[0] * np.arange(1, 65)
    samples = basis.T @ square.reshape(8, 8) @ basis + 128
    own = rgb[: min(8, height), : min(8, width), 0].astype(float)
    assert np.abs(own - np.clip(samples, 0, 255)[: own.shape[0], : own.shape[1]]).max() <= 1


@pytest.mark.parametrize("size", [576, 1152, 576 * 7, 576 * 1000])
def test_payload_round_trip(size):
    for payload in (bytes(size), b"\xff" * size, random.Random(size).randbytes(size)):
        stream = jpeg.encode_payload(payload)
        picture = jpeg.decode(stream)
        assert jpeg.read_payload(picture) == payload
        assert jpeg.to_rgb(picture).shape == (picture.height, picture.width, 3)


def test_long_runs_of_blocks():
    payload = random.Random(1).randbytes(576 * 8000)
    assert jpeg.read_payload(jpeg.decode(jpeg.encode_payload(payload))) == payload


def test_bad_streams():
    good = jpeg.encode_payload(bytes(576))
    for bad in (b"", b"\xff\xd8", good[:100], good[:-2], good[:-40] + good[-2:], good.replace(b"\xff\xc2", b"\xff\xc0"), b"GIF" + good):
        with pytest.raises(ValueError):
            jpeg.decode(bad)


def test_documents(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "abc", "x"), (4, "é" * 288, None), (4, "abc", None), (None, "y" * 50_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, feature string").repartition(2)
    found = media.digest_documents(docs).collect()
    assert len(found) == len(rows)
    by = {}
    for (i, text, _), r in zip(sorted(rows, key=lambda r: (str(r[0]), r[1] or "")), sorted(found, key=lambda r: (str(r["doc_id"]), r["n_bytes"])), strict=True):
        data = (text or "").encode()
        payload = data + b"\xff" * (576 if not data else -len(data) % 576)
        assert (r["doc_id"], r["n_bytes"], r["payload_bytes"]) == (i, len(data), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
        by.setdefault(payload, set()).add((r["media_sha256"], r["media_bytes"], r["feature"]))
    assert all(len(v) == 1 for v in by.values())
    encoded = media.encode_media(docs).cache()
    decoded = media.decode_media(encoded).collect()
    assert all(len(r["rgb"]) == r["height"] * r["width"] * 3 for r in decoded)
    assert sorted(hashlib.sha256(r["payload"]).hexdigest() for r in decoded) == sorted(r["payload_sha256"] for r in found)
    assert media.digest_documents(docs.limit(0)).count() == 0
