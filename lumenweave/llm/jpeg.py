"""Baseline JPEG: a lossless carrier for bytes, and a decoder of baseline scans in numpy.

Carrier. A grey baseline image holds 64 bytes in the 64 quantised coefficients of each
8 x 8 block (quantisation by 1), in zigzag order. Byte 0 is coefficient 0; 1 to 127 are
themselves; 128 to 254 are -127 to -1; 255 is 128. The image's own Huffman table gives size
category s (7 to 1) a code of 8 - s bits, so most coefficients take eight bits in all. Every
block ends a restart interval, and an application segment holds the payload's length. The
blocks are laid out in a near-square; those beyond the payload are zero.

Decoder. Markers are parsed, stuffing is removed, and all restart intervals are
Huffman-decoded side by side: one step reads one symbol of every interval that is not
finished, by a table over the next 16 bits. Images without restart markers are one interval.
One or three components, with any sampling factors, are read.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np

# Marker codes of the format.
SOI, EOI, SOS, DQT, DHT, DRI, SOF0, SOF1, APP9 = 0xD8, 0xD9, 0xDA, 0xDB, 0xC4, 0xDD, 0xC0, 0xC1, 0xE9
MAGIC = b"bytes-64\0"
BLOCK = 64


def _zigzag() -> np.ndarray:
    """Row-major place of each coefficient in scan order."""
    by_diagonal = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))
    return np.array(by_diagonal)


ZIGZAG = _zigzag()


class Table:
    """A Huffman table: counts of codes by length, and their symbols in order."""

    def __init__(self, counts: list[int], symbols: list[int]):
        self.counts, self.symbols = list(counts), list(symbols)
        self.code: dict[int, tuple[int, int]] = {}
        self.length = np.zeros(1 << 16, np.uint8)
        self.symbol = np.zeros(1 << 16, np.uint8)
        code, k = 0, 0
        for bits in range(1, 17):
            for _ in range(self.counts[bits - 1]):
                self.code[self.symbols[k]] = (code, bits)
                low = code << (16 - bits)
                self.length[low : low + (1 << (16 - bits))] = bits
                self.symbol[low : low + (1 << (16 - bits))] = self.symbols[k]
                code, k = code + 1, k + 1
            code <<= 1

    def segment(self, kind: int, number: int) -> bytes:
        return bytes([kind << 4 | number, *self.counts, *self.symbols])


def _carrier_tables() -> tuple[Table, Table]:
    """Codes of 1 to 7 bits for sizes 7 to 1, then end of block (or size 0), then size 8, then runs of zeros at 16 bits."""
    dc = Table([1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], [7, 6, 5, 4, 3, 2, 1, 0, 8])
    runs = [0xF0] + [r << 4 | s for r in range(1, 16) for s in range(1, 9)]
    ac = Table([1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, len(runs)], [7, 6, 5, 4, 3, 2, 1, 0x00, 8, *runs])
    return dc, ac


DC_TABLE, AC_TABLE = _carrier_tables()


def _value(byte: int) -> int:
    return byte if byte < 128 else 128 if byte == 255 else byte - 255


_VALUES = np.array([_value(b) for b in range(256)], np.int16)


def _bits(value: int) -> tuple[int, int]:
    size = abs(value).bit_length()
    return (value if value >= 0 else value + (1 << size) - 1), size


def _coded(value: int) -> int:
    """The whole eight bits of a coefficient other than 0 and 128."""
    low, size = _bits(value)
    code, _ = AC_TABLE.code[size]
    return code << size | low


#: Byte -> its eight bits, where eight bits suffice (sizes 1 to 7 have one code in both tables).
_PLAIN = bytes(_coded(_value(b)) if b not in (0, 255) else 0 for b in range(256))
_END = bytes([AC_TABLE.code[0][0]])


def _coded_block(block: bytes) -> bytes:
    """The entropy-coded bytes of one block with zeros or 255 in it."""
    filled = block.rstrip(b"\0")
    if filled and 0 not in filled and 255 not in filled:
        return filled.translate(_PLAIN) + (_END if len(filled) < BLOCK else b"")
    out, n = 0, 0

    def put(code: int, bits: int) -> None:
        nonlocal out, n
        out, n = out << bits | code, n + bits

    low, size = _bits(_value(block[0]))
    put(*DC_TABLE.code[size])
    put(low, size)
    run = 0
    for b in filled[1:]:
        if b == 0:
            run += 1
            continue
        while run > 15:
            put(*AC_TABLE.code[0xF0])
            run -= 16
        low, size = _bits(_value(b))
        put(*AC_TABLE.code[run << 4 | size])
        put(low, size)
        run = 0
    if len(filled) < BLOCK:
        put(*AC_TABLE.code[0])
    pad = -n % 8
    put((1 << pad) - 1, pad)
    return out.to_bytes(n // 8, "big").replace(b"\xff", b"\xff\x00")


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body


def pad(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return data + b"\0" * (BLOCK if not data else -len(data) % BLOCK)


def layout(blocks: int) -> tuple[int, int]:
    """Blocks across and down."""
    across = int(np.ceil(np.sqrt(blocks)))
    return across, -(-blocks // across)


def encode(payload: bytes) -> bytes:
    """A baseline JPEG file that holds payload (a positive multiple of 64 bytes)."""
    n = len(payload) // BLOCK
    across, down = layout(n)
    head = b"\xff\xd8" + _segment(APP9, MAGIC + struct.pack(">Q", len(payload))) + _segment(DQT, bytes([0] + [1] * 64))
    head += _segment(SOF0, struct.pack(">BHHB", 8, down * 8, across * 8, 1) + bytes([1, 0x11, 0]))
    head += _segment(DHT, DC_TABLE.segment(0, 0) + AC_TABLE.segment(1, 0)) + _segment(DRI, struct.pack(">H", 1)) + _segment(SOS, bytes([1, 1, 0x00, 0, 63, 0]))
    coded = []
    plain = payload.translate(_PLAIN)
    raw = np.frombuffer(payload, np.uint8).reshape(n, BLOCK)
    odd = ((raw == 0) | (raw == 255)).any(axis=1)
    for k in range(n):
        coded.append(_coded_block(payload[k * BLOCK : (k + 1) * BLOCK]) if odd[k] else plain[k * BLOCK : (k + 1) * BLOCK])
        coded.append(bytes([0xFF, 0xD0 + k % 8]))
    empty = _coded_block(bytes(BLOCK))
    for k in range(n, across * down):
        coded.append(empty)
        coded.append(bytes([0xFF, 0xD0 + k % 8]))
    coded[-1] = b"\xff\xd9"
    return head + b"".join(coded)


class Frame:
    """What the markers of a file say: size, components, tables, and where its scan's data lies."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        self.quant: dict[int, np.ndarray] = {}
        self.tables: dict[int, Table] = {}
        self.restart, self.payload, at = 0, None, 2
        while True:
            if data[at] != 0xFF:
                raise ValueError("a marker is missing")
            marker = data[at + 1]
            if marker == 0xFF:  # fill byte
                at += 1
                continue
            n = struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + n]
            at += 2 + n
            if marker == DQT:
                self._quantisers(body)
            elif marker == DHT:
                self._huffman(body)
            elif marker == DRI:
                self.restart = struct.unpack(">H", body)[0]
            elif marker in (SOF0, SOF1):
                _, self.height, self.width, count = struct.unpack_from(">BHHB", body)
                self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(count)]
            elif marker == APP9 and body.startswith(MAGIC):
                self.payload = struct.unpack_from(">Q", body, len(MAGIC))[0]
            elif 0xC2 <= marker <= 0xCF and marker not in (DHT, 0xC8, 0xCC):
                raise ValueError("not a baseline file")
            elif marker == SOS:
                self.scan = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
                break
        self.start = at

    def _quantisers(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            wide, number = body[at] >> 4, body[at] & 15
            n = 128 if wide else 64
            self.quant[number] = np.frombuffer(body[at + 1 : at + 1 + n], ">u2" if wide else np.uint8).astype(np.int32)
            at += 1 + n

    def _huffman(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            counts = body[at + 1 : at + 17]
            n = sum(counts)
            self.tables[body[at]] = _table(counts, body[at + 17 : at + 17 + n])
            at += 17 + n

    def units(self) -> list[tuple[int, int, int]]:
        """The blocks of one MCU, in scan order: component number, its DC and its AC table."""
        single = len(self.parts) == 1
        return [(c, *self.scan[name]) for c, (name, h, v, _) in enumerate(self.parts) for _ in range(1 if single else h * v)]

    def mcus(self) -> tuple[int, int]:
        single = len(self.parts) == 1
        w, h = (8, 8) if single else (8 * max(p[1] for p in self.parts), 8 * max(p[2] for p in self.parts))
        return -(-self.width // w), -(-self.height // h)


@lru_cache(maxsize=64)
def _table(counts: bytes, symbols: bytes) -> Table:
    return Table(list(counts), list(symbols))


def _intervals(data: bytes, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Scan bytes without stuffing and markers; first byte of each restart interval, and the end."""
    raw = np.frombuffer(data, np.uint8, offset=start)
    ff = np.flatnonzero(raw[:-1] == 0xFF)
    after = raw[ff + 1]
    ends = ff[(after != 0) & ~((after >= 0xD0) & (after <= 0xD7)) & (after != 0xFF)]
    end = int(ends[0]) if len(ends) else len(raw)
    ff, after = ff[ff < end], after[ff < end]
    keep = np.ones(end, bool)
    keep[ff[after == 0] + 1] = False
    marks = ff[(after >= 0xD0) & (after <= 0xD7)]
    keep[marks] = keep[marks + 1] = False
    kept = np.cumsum(keep)
    return raw[:end][keep], np.concatenate([[0], kept[marks] if len(marks) else [], [kept[-1] if end else 0]]).astype(np.int64)


def coefficients(files: list[bytes], frames: list[Frame] | None = None) -> list[np.ndarray]:
    """Quantised coefficients of each file, (blocks in scan order, 64) in zigzag order. Files of one layout are decoded side by side."""
    frames = frames or [Frame(f) for f in files]
    out: list = [None] * len(files)
    groups: dict[tuple, list[int]] = {}
    for i, f in enumerate(frames):
        groups.setdefault((tuple((c, id(f.tables[d]), id(f.tables[16 | a])) for c, d, a in f.units()),), []).append(i)
    for members in groups.values():
        _decode_group(files, frames, members, out)
    return out


def _decode_group(files, frames, members, out) -> None:
    units = frames[members[0]].units()
    per_mcu = len(units)
    datas, starts, lane_first, lane_last, total, at = [], [], [], [], 0, 0
    shares = []
    for i in members:
        f = frames[i]
        across, down = f.mcus()
        data, cuts = _intervals(files[i], f.start)
        each = f.restart or across * down
        lanes = -(-across * down // each)
        if len(cuts) - 1 < lanes:
            raise ValueError("a restart interval is missing")
        first = total + np.arange(lanes) * each * per_mcu
        lane_first.append(first)
        lane_last.append(np.minimum(first + each * per_mcu, total + across * down * per_mcu))
        starts.append(cuts[:lanes] + at)
        datas.append(data)
        at += len(data)
        shares.append((i, total, total + across * down * per_mcu))
        total += across * down * per_mcu
    raw = np.concatenate([*datas, np.full(16, 0xFF, np.uint8)])
    coefs = _decode_lanes(raw, np.concatenate(starts) * 8, np.concatenate(lane_first), np.concatenate(lane_last), total, units, frames[members[0]].tables)
    for i, a, b in shares:
        out[i] = coefs[a:b]


def _decode_lanes(raw, bit, block, last, total, units, tables):
    """One symbol of every open lane a step. bit: its place in raw; block: the block it fills, up to last."""
    coefs = np.zeros(total * 64, np.int16)
    bit, block, last = bit.astype(np.int64), block.copy(), last.copy()
    wide = np.zeros(len(raw), np.uint32)  # the four bytes from each place on
    n = len(raw) - 3
    for j in range(4):
        wide[:n] |= raw[j : j + n].astype(np.uint32) << np.uint32(24 - 8 * j)
    unit_of = np.arange(len(units))
    dc_no = np.array([d for _, d, _ in units])
    ac_no = np.array([a for _, _, a in units])
    part = np.array([c for c, _, _ in units])
    length = np.stack([tables[k].length if k in tables else np.zeros(1 << 16, np.uint8) for k in (0, 1, 2, 3, 16, 17, 18, 19)]).ravel()
    symbol = np.stack([tables[k].symbol if k in tables else np.zeros(1 << 16, np.uint8) for k in (0, 1, 2, 3, 16, 17, 18, 19)]).ravel()
    one = len(units) == 1
    dc_at, ac_at = dc_no << 16, (ac_no + 4) << 16
    before = np.zeros((len(bit), int(part.max()) + 1), np.int32)
    k = np.zeros(len(bit), np.int64)
    unit = np.zeros(len(bit), np.int64)
    lane = np.arange(len(bit))
    end = len(raw) * 8 - 32
    while len(bit):
        if (bit > end).any():
            raise ValueError("a scan ends early")
        word = wide[bit >> 3] << (bit & 7).astype(np.uint32)
        is_dc = k == 0
        base = np.where(is_dc, dc_at[0], ac_at[0]) if one else np.where(is_dc, dc_at[unit], ac_at[unit])
        entry = base + (word >> np.uint32(16))
        bits = length[entry].astype(np.int64)
        if not bits.all():
            raise ValueError("a code is not in its table")
        sym = symbol[entry].astype(np.int64)
        run, size = sym >> 4, sym & 15
        at = bit + bits
        extra = (wide[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(8)  # 24 bits and more
        value = (extra >> (24 - size).astype(np.uint32)).astype(np.int64)
        value = np.where((value >> np.maximum(size - 1, 0)) & 1 | (size == 0), value, value - (np.int64(1) << size) + 1)
        bit = at + size
        if is_dc.any():
            rows, c = lane[is_dc], part[unit[is_dc]]
            before[rows, c] += value[is_dc].astype(np.int32)
            value[is_dc] = before[rows, c]
        place = np.where(is_dc, 0, k + run)
        put = is_dc | (size > 0)
        if (place[put] > 63).any():
            raise ValueError("a block has too many coefficients")
        coefs[block[put] * 64 + place[put]] = value[put]
        k = np.where(is_dc, 1, np.where(sym == 0, 64, k + run + 1))
        full = k >= 64
        if full.any():
            block = block + full
            k[full] = 0
            unit = np.where(full, (unit + 1) % len(unit_of), unit)
            open_ = block < last
            if not open_.all():
                bit, block, last, k, unit, lane = bit[open_], block[open_], last[open_], k[open_], unit[open_], lane[open_]
    return coefs.reshape(total, 64)


_BYTES = np.zeros(256 + 128, np.uint8)
_BYTES[_VALUES + 127] = np.arange(256)


def payload(frame: Frame, coefs: np.ndarray) -> bytes:
    """The bytes that a carrier holds."""
    if frame.payload is None:
        raise ValueError("the file holds no payload")
    return _BYTES[coefs.ravel()[: frame.payload] + 127].tobytes()


def thumbnail(frame: Frame, coefs: np.ndarray) -> np.ndarray:
    """The luminance of each 8 x 8 block by its DC coefficient alone, as an image of 0 to 255."""
    name, h, v, q = frame.parts[0]
    across, down = frame.mcus()
    if len(frame.parts) == 1:
        h = v = 1
    per_mcu = len(frame.units())
    dc = coefs[:, 0].reshape(down, across, per_mcu)[:, :, : h * v].reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
    light = dc.astype(np.float64) * frame.quant[q][0] / 8 + 128
    return np.clip(np.rint(light), 0, 255).astype(np.uint8)[: -(-frame.height // 8), : -(-frame.width // 8)]


def average_hash(image: np.ndarray, side: int = 8) -> int:
    """A bit for each cell of a side x side grid: whether its mean is above the mean of the image."""
    rows = (np.arange(side) * image.shape[0] // side, np.maximum((np.arange(side) + 1) * image.shape[0] // side, np.arange(side) * image.shape[0] // side + 1))
    cols = (np.arange(side) * image.shape[1] // side, np.maximum((np.arange(side) + 1) * image.shape[1] // side, np.arange(side) * image.shape[1] // side + 1))
    total = np.zeros((image.shape[0] + 1, image.shape[1] + 1))
    total[1:, 1:] = image.astype(np.float64).cumsum(0).cumsum(1)
    r0, r1, c0, c1 = rows[0][:, None], rows[1][:, None], cols[0][None], cols[1][None]
    cells = (total[r1, c1] - total[r0, c1] - total[r1, c0] + total[r0, c0]) / ((r1 - r0) * (c1 - c0))
    out = 0
    for above in (cells > image.mean()).ravel():
        out = out << 1 | int(above)
    return out
