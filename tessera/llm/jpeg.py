"""A progressive JPEG (SOF2) codec in numpy.

``decode`` accumulates the scans of a stream into coefficient arrays, whatever their spectral
selection and successive approximation, and ``to_rgb`` turns those into a full-resolution tensor:
inverse transform as one matrix product, chroma by replication, colours by the usual equations.
Arithmetic coding, restart intervals, hierarchical and baseline frames raise ``ValueError``, as do
truncated streams.

``encode_payload`` stores bytes without loss in the format's unit, the quantised coefficient. With
all quantisers 1, a byte becomes the first coefficient of a block as ``b - 128``, and each other
one as ``b`` (128 up) or ``b - 255``: those 256 values are the magnitude category 8, whose extra
bits are the byte itself. Chroma is subsampled by 2 both ways; the payload fills the luma blocks,
then the two chroma planes, and zero bytes fill the last blocks. An APP9 segment holds the length.
"""

from __future__ import annotations

import struct
from functools import cache

import numpy as np

# Fixed values of the format.
ZIGZAG = np.array(
    [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63]
)
SOI, EOI, SOS, DQT, DHT, SOF2, DRI, APP9 = 0xD8, 0xD9, 0xDA, 0xDB, 0xC4, 0xC2, 0xDD, 0xE9
#: The longest end-of-band run.
LONGEST_RUN = 32_767
SIGNATURE = b"PAYLOAD\0"
#: Symbols of the writer's tables, all of 4 bits but the one of ``AC_FIRST``, of 1 bit.
DC_SYMBOLS = bytes(range(9))
AC_FIRST = bytes([0x07])
AC_REFINE = bytes(n << 4 for n in range(15))


@cache
def inverse_matrix() -> np.ndarray:
    """64 x 64, from coefficients in zigzag order to samples in rows."""
    k, x = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    basis = np.cos((2 * x + 1) * k * np.pi / 16) / 2
    basis[0] /= np.sqrt(2)
    both = np.einsum("ux,vy->uvxy", basis, basis).reshape(64, 64)
    return np.ascontiguousarray(both[ZIGZAG], np.float32)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _huffman(kind: int, ident: int, length: int, symbols: bytes) -> bytes:
    counts = bytes(len(symbols) if n == length else 0 for n in range(1, 17))
    return _segment(DHT, bytes([kind << 4 | ident]) + counts + symbols)


def _scan(components: list[tuple[int, int]], first: int, last: int, high: int, low: int, data: bytes) -> bytes:
    head = bytes([len(components), *(x for pair in components for x in pair), first, last, high << 4 | low])
    return _segment(SOS, head) + data.replace(b"\xff", b"\xff\x00")


def _pack(bits: np.ndarray) -> bytes:
    """Whole bytes, filled up with ones."""
    return np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])).tobytes()


def _mcu_order(rows: int, columns: int, v: int, h: int) -> np.ndarray:
    """Raster indexes of a component's blocks, unit by unit: (units, v * h)."""
    index = np.arange(rows * columns).reshape(rows // v, v, columns // h, h)
    return index.transpose(0, 2, 1, 3).reshape(-1, v * h)


def _category(values: np.ndarray) -> np.ndarray:
    """Bits of the magnitude: 0 for 0, 1 for 1, 2 for 2 and 3, ..."""
    return np.frexp(np.abs(values).astype(np.float32))[1].astype(np.int64)


def encode_payload(payload: bytes) -> bytes:
    blocks = -(-len(payload) // 64)
    units = max(1, -(-blocks // 6))
    wide = int(np.ceil(np.sqrt(units)))
    high = -(-units // wide)
    if max(wide, high) > 4095:
        raise ValueError("the payload exceeds the largest picture")
    units = wide * high
    data = np.zeros(units * 6 * 64, np.uint8)
    data[: len(payload)] = np.frombuffer(payload, np.uint8)
    data = data.reshape(-1, 64)
    planes = [data[: 4 * units], data[4 * units : 5 * units], data[5 * units :]]

    orders = [_mcu_order(2 * high, 2 * wide, 2, 2), _mcu_order(high, wide, 1, 1), _mcu_order(high, wide, 1, 1)]
    dc = [plane[:, 0].astype(np.int64)[order] - 128 for plane, order in zip(planes, orders, strict=True)]
    # First DC scan, without the lowest bit: differences within each component, in coded order.
    gaps = [np.diff((d >> 1).ravel(), prepend=0).reshape(d.shape) for d in dc]
    gap = np.concatenate(gaps, axis=1).ravel()
    size = _category(gap)
    extra = np.where(gap < 0, gap + (1 << size) - 1, gap)
    code, length = (size << size) | extra, 4 + size
    shift = length[:, None] - 1 - np.arange(12)
    bits = ((code[:, None] >> np.maximum(shift, 0)) & 1).astype(np.uint8)[shift >= 0]
    dc_first = _pack(bits)
    dc_refine = _pack((np.concatenate(dc, axis=1).ravel() & 1).astype(np.uint8))

    def ac_first(plane: np.ndarray, first: int, last: int) -> bytes:
        # The code 0 and 7 extra bits make a byte: the payload's, without its lowest bit.
        return (plane[:, first : last + 1] >> 1).tobytes()

    def ac_refine(plane: np.ndarray) -> bytes:
        # No new coefficients, hence end-of-band runs, each with a correction bit per coefficient.
        corrections = ((plane[:, 1:] & 1) ^ (plane[:, 1:] < 128)).astype(np.uint8)
        parts = []
        for at in range(0, len(plane), LONGEST_RUN):
            run = corrections[at : at + LONGEST_RUN]
            n = len(run).bit_length() - 1
            head = n << n | (len(run) - (1 << n))
            parts += [np.array([head >> (n + 3 - k) & 1 for k in range(n + 4)], np.uint8), run.ravel()]
        return _pack(np.concatenate(parts))

    out = [b"\xff", bytes([SOI]), _segment(APP9, SIGNATURE + struct.pack(">Q", len(payload))), _segment(DQT, b"\0" + b"\1" * 64)]
    out += [_segment(SOF2, struct.pack(">BHHB", 8, 16 * high, 16 * wide, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))]
    out += [_huffman(0, 0, 4, DC_SYMBOLS), _huffman(1, 0, 1, AC_FIRST), _huffman(1, 1, 4, AC_REFINE)]
    out += [_scan([(1, 0), (2, 0), (3, 0)], 0, 0, 0, 1, dc_first)]
    out += [_scan([(1, 0)], 1, 5, 0, 1, ac_first(planes[0], 1, 5)), _scan([(2, 0)], 1, 63, 0, 1, ac_first(planes[1], 1, 63)), _scan([(3, 0)], 1, 63, 0, 1, ac_first(planes[2], 1, 63)), _scan([(1, 0)], 6, 63, 0, 1, ac_first(planes[0], 6, 63))]
    out += [_scan([(k + 1, 1)], 1, 63, 1, 0, ac_refine(plane)) for k, plane in enumerate(planes)]
    out += [_scan([(1, 0), (2, 0), (3, 0)], 0, 0, 1, 0, dc_refine), b"\xff", bytes([EOI])]
    return b"".join(out)


class Component:
    def __init__(self, ident: int, h: int, v: int, table: int):
        self.ident, self.h, self.v, self.table = ident, h, v, table


class Picture:
    """Coefficients of a stream: per component (block rows, block columns, 64), zigzag order."""

    def __init__(self, width: int, height: int, components: list[Component]):
        self.width, self.height, self.components = width, height, components
        self.h = max(c.h for c in components)
        self.v = max(c.v for c in components)
        wide, high = -(-width // (8 * self.h)), -(-height // (8 * self.v))
        for c in components:
            c.rows, c.columns = high * c.v, wide * c.h
            c.coefficients = np.zeros((c.rows * c.columns, 64), np.int32)
        self.quantisers: dict[int, np.ndarray] = {}
        self.segments: dict[int, bytes] = {}

    def own_order(self, c: Component) -> np.ndarray:
        """Blocks of a scan that has this component alone: those that the picture needs."""
        rows = -(-(-(-self.height * c.v // self.v)) // 8)
        columns = -(-(-(-self.width * c.h // self.h)) // 8)
        return np.arange(c.rows * c.columns).reshape(c.rows, c.columns)[:rows, :columns].ravel()


@cache
def _lookup(lengths: bytes, symbols: bytes) -> list[tuple[int, int] | None]:
    """Length and symbol of the code that begins each 16-bit word."""
    table: list[tuple[int, int] | None] = []
    at = 0
    for length, count in enumerate(lengths, 1):
        for symbol in symbols[at : at + count]:
            table += [(length, symbol)] * (1 << (16 - length))
        at += count
    return table + [None] * (65_536 - len(table))


class Bits:
    """A reader of entropy-coded bits."""

    def __init__(self, data: bytes):
        self.size = 8 * len(data)
        self.data = data + b"\xff\xff\xff\xff"
        self.at = 0

    def peek16(self) -> int:
        k = self.at >> 3
        d = self.data
        return ((d[k] << 16 | d[k + 1] << 8 | d[k + 2]) >> (8 - (self.at & 7))) & 0xFFFF

    def symbol(self, table: list) -> int:
        if self.at >= self.size:
            raise ValueError("the scan ends early")
        found = table[self.peek16()]
        if found is None:
            raise ValueError("no such code")
        self.at += found[0]
        return found[1]

    def take(self, n: int) -> int:
        if self.at + n > self.size:
            raise ValueError("the scan ends early")
        value = self.peek16() >> (16 - n) if n else 0
        self.at += n
        return value

    def signed(self, n: int) -> int:
        value = self.take(n)
        return value - (1 << n) + 1 if n and not value >> (n - 1) else value

    def array(self, n: int) -> np.ndarray:
        if self.at + n > self.size:
            raise ValueError("the scan ends early")
        first = self.at >> 3
        bits = np.unpackbits(np.frombuffer(self.data, np.uint8, -(-(self.at + n) // 8) - first, first))
        found = bits[self.at & 7 : (self.at & 7) + n]
        self.at += n
        return found


def _dc_first(bits: Bits, columns: list[tuple[Component, np.ndarray, list]], low: int) -> None:
    """``columns``: a component, its blocks (units, blocks a unit) and its table."""
    last = [0] * len(columns)
    found: list[list[int]] = [[] for _ in columns]
    symbol, signed = bits.symbol, bits.signed
    plan = [(k, table) for k, (_, order, table) in enumerate(columns) for _ in range(order.shape[1])]
    for _ in range(len(columns[0][1])):
        for k, table in plan:
            last[k] += signed(symbol(table))
            found[k].append(last[k])
    for (c, order, _), values in zip(columns, found, strict=True):
        c.coefficients[order.ravel(), 0] = np.array(values, np.int64) << low


def _dc_refine(bits: Bits, columns: list[tuple[Component, np.ndarray, list]], low: int) -> None:
    widths = [order.shape[1] for _, order, _ in columns]
    both = bits.array(len(columns[0][1]) * sum(widths)).reshape(-1, sum(widths)).astype(np.int32)
    at = 0
    for (c, order, _), width in zip(columns, widths, strict=True):
        c.coefficients[order.ravel(), 0] |= both[:, at : at + width].ravel() << low
        at += width


def _ac_first(bits: Bits, blocks: np.ndarray, order: np.ndarray, first: int, last: int, low: int, lengths: bytes, symbols: bytes) -> None:
    table = _lookup(lengths, symbols)
    if len(symbols) == 1 and symbols[0] >> 4 == 0 and 0 < symbols[0] < 16:
        # The only code gives a coefficient of one size without a run: fields of one width.
        size = symbols[0]
        width = lengths.index(1) + 1 + size
        count = len(order) * (last - first + 1)
        if width == 8 and not bits.at:
            if 8 * count > bits.size:
                raise ValueError("the scan ends early")
            values = np.frombuffer(bits.data, np.uint8, count).astype(np.int32) & ((1 << size) - 1)
        else:
            fields = bits.array(count * width).reshape(count, width)[:, width - size :].astype(np.int32)
            values = fields @ (1 << np.arange(size)[::-1]).astype(np.int32)
        values += np.where(values >> (size - 1), 0, 1 - (1 << size)).astype(np.int32)
        blocks[order, first : last + 1] = (values << low if low else values).reshape(len(order), -1)
        return
    run = 0
    for b in order:
        if run:
            run -= 1
            continue
        k = first
        while k <= last:
            symbol = bits.symbol(table)
            zeros, size = symbol >> 4, symbol & 15
            if size:
                k += zeros
                if k > last:
                    raise ValueError("a run leaves the band")
                blocks[b, k] = bits.signed(size) << low
                k += 1
            elif zeros == 15:
                k += 16
            else:
                run = (1 << zeros) + bits.take(zeros) - 1
                break


def _correct(bits: Bits, part: np.ndarray, low: int) -> None:
    """One bit for every coefficient of ``part`` that is not 0 so far."""
    known = part != 0
    n = int(np.count_nonzero(known))
    if n == part.size:
        part += (np.sign(part) * bits.array(n).reshape(part.shape)) << low
    elif n:
        values = part[known]
        part[known] = values + ((np.sign(values) * bits.array(n)) << low)


def _ac_refine(bits: Bits, blocks: np.ndarray, order: np.ndarray, first: int, last: int, low: int, lengths: bytes, symbols: bytes) -> None:
    table = _lookup(lengths, symbols)
    at = 0
    while at < len(order):
        row, k = blocks[order[at]], first
        while k <= last:
            symbol = bits.symbol(table)
            zeros, size = symbol >> 4, symbol & 15
            if not size and zeros < 15:
                run = (1 << zeros) + bits.take(zeros)
                if k > first:
                    _correct(bits, row[k : last + 1], low)
                    at, run = at + 1, run - 1
                whole = order[at : at + run]
                part = blocks[whole, first : last + 1]
                _correct(bits, part, low)
                blocks[whole, first : last + 1] = part
                at += run - 1
                break
            new = 0
            if size:
                new = 1 << low if bits.take(1) else -(1 << low)
            while k <= last:
                if row[k]:
                    if bits.take(1):
                        row[k] += (1 << low) if row[k] > 0 else -(1 << low)
                elif zeros:
                    zeros -= 1
                else:
                    break
                k += 1
            if new:
                if k > last:
                    raise ValueError("a run leaves the band")
                row[k] = new
            k += 1
        at += 1


def decode(stream: bytes) -> Picture:
    try:
        return _decode(stream)
    except (struct.error, IndexError, KeyError) as e:
        raise ValueError("a segment is cut short or lacks what it names") from e


def _decode(stream: bytes) -> Picture:
    if stream[:2] != b"\xff\xd8":
        raise ValueError("no JPEG stream")
    at, picture, tables = 2, None, {}
    quantisers: dict[int, np.ndarray] = {}
    segments: dict[int, bytes] = {}
    while True:
        if at + 2 > len(stream) or stream[at] != 0xFF:
            raise ValueError("no marker where one should be")
        marker = stream[at + 1]
        at += 2
        if marker == EOI:
            break
        (size,) = struct.unpack_from(">H", stream, at)
        body, at = stream[at + 2 : at + size], at + size
        if marker == DQT:
            while body:
                wide = body[0] >> 4
                quantisers[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.float32)
                body = body[1 + 64 * (1 + wide) :]
        elif marker == DHT:
            while body:
                lengths = body[1:17]
                tables[body[0]] = (lengths, body[17 : 17 + sum(lengths)])
                body = body[17 + sum(lengths) :]
        elif marker == SOF2:
            bits, height, width, n = struct.unpack_from(">BHHB", body)
            if bits != 8 or not height or not width:
                raise ValueError("only 8-bit frames of a stated size")
            picture = Picture(width, height, [Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)])
        elif 0xC0 <= marker <= 0xCF:
            raise ValueError("only progressive Huffman frames")
        elif marker == DRI and body != b"\0\0":
            raise ValueError("restart intervals are not supported")
        elif marker == SOS:
            if picture is None:
                raise ValueError("a scan before its frame")
            end = at
            while True:
                end = stream.find(b"\xff", end)
                if end < 0 or end + 1 >= len(stream):
                    raise ValueError("the stream ends in a scan")
                if stream[end + 1]:
                    break
                end += 2
            _decode_scan(picture, body, stream[at:end].replace(b"\xff\x00", b"\xff"), tables)
            at = end
        else:
            segments[marker] = body
    if picture is None:
        raise ValueError("no frame")
    picture.quantisers, picture.segments = quantisers, segments
    return picture


def _decode_scan(picture: Picture, head: bytes, data: bytes, tables: dict[int, tuple[bytes, bytes]]) -> None:
    n = head[0]
    by_id = {c.ident: c for c in picture.components}
    chosen = [(by_id[head[1 + 2 * k]], head[2 + 2 * k]) for k in range(n)]
    first, last, high, low = head[1 + 2 * n], head[2 + 2 * n], head[3 + 2 * n] >> 4, head[3 + 2 * n] & 15
    bits = Bits(data)
    if first == 0:
        if last:
            raise ValueError("a progressive DC scan has no other coefficients")
        columns = []
        for c, ids in chosen:
            order = _mcu_order(c.rows, c.columns, c.v, c.h) if n > 1 else picture.own_order(c)[:, None]
            columns.append((c, order, _lookup(*tables[ids >> 4]) if not high else []))
        (_dc_refine if high else _dc_first)(bits, columns, low)
    else:
        if n > 1 or last > 63 or last < first:
            raise ValueError("a progressive AC scan has one component and a band")
        c, ids = chosen[0]
        step = _ac_refine if high else _ac_first
        step(bits, c.coefficients, picture.own_order(c), first, last, low, *tables[0x10 | ids & 15])


def to_rgb(picture: Picture) -> np.ndarray:
    """(height, width, 3) of bytes."""
    planes = []
    for c in picture.components:
        samples = (c.coefficients.astype(np.float32) * picture.quantisers[c.table]) @ inverse_matrix()
        plane = samples.reshape(c.rows, c.columns, 8, 8).transpose(0, 2, 1, 3).reshape(8 * c.rows, 8 * c.columns)
        for axis, by in ((0, picture.v // c.v), (1, picture.h // c.h)):
            if by > 1:
                plane = np.repeat(plane, by, axis)
        planes.append(plane[: picture.height, : picture.width])
    if len(planes) == 1:
        planes = [planes[0], np.zeros_like(planes[0]), np.zeros_like(planes[0])]
    y, cb, cr = planes
    y = y + np.float32(128.5)
    rgb = np.empty((*y.shape, 3), np.uint8)
    for k, value in enumerate((y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb)):
        rgb[:, :, k] = np.clip(value, 0, 255, out=value)
    return rgb


def read_payload(picture: Picture) -> bytes:
    """The bytes that ``encode_payload`` stored."""
    body = picture.segments.get(APP9, b"")
    if not body.startswith(SIGNATURE):
        raise ValueError("the picture holds no payload")
    (length,) = struct.unpack(">Q", body[len(SIGNATURE) :])
    parts = []
    for c in picture.components:
        values = c.coefficients
        stored = np.where(values < 0, values + 255, values)
        stored[:, 0] = values[:, 0] + 128
        parts.append(stored.astype(np.uint8).tobytes())
    return b"".join(parts)[:length]
