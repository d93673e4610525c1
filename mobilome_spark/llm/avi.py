"""AVI files of motion-JPEG frames that hold bytes exactly.

A frame is a baseline JPEG of one component. Each byte is one quantised
coefficient of category 8, whose eight amplitude bits are the byte itself: the
byte b stands for the coefficient b where b >= 128, else b - 255. Every block
restarts the DC prediction, so the 64 coefficients of a block are 64 bytes of
the payload. The Huffman tables have the single symbol 8 with a one-bit code.
JPEG's samples would be rounded by the transform; its coefficients are not.

``parse_frame`` reads such frames at array speed and any other baseline frame
symbol by symbol: several components with their sampling factors, interleaved or
not, restarts, and the usual Huffman tables where the frame has none.
``pixels`` dequantises a component and takes it through the inverse transform,
in whole numbers, so that equal frames have equal pixels everywhere.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

#: Blocks of a full frame (64 x 64 samples), and frames per second.
BLOCKS, RATE = 64, 25
SIDE = 8

# The order in which JPEG stores the coefficients of a block.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(width: int, height: int) -> bytes:
    table = bytes([1] + [0] * 15) + b"\x08"  # one code of one bit, for symbol 8
    return (
        b"\xff\xd8"
        + _segment(0xDB, b"\x00" + b"\x01" * 64)
        + _segment(0xC0, struct.pack(">BHHB", 8, height, width, 1) + b"\x01\x11\x00")
        + _segment(0xC4, b"\x00" + table)
        + _segment(0xC4, b"\x10" + table)
        + _segment(0xDD, struct.pack(">H", 1))
        + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    )


_SINGLE = (_segment(0xC4, b"\x00" + bytes([1] + [0] * 15) + b"\x08"), _segment(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\x08"))


def _pack(groups: np.ndarray) -> np.ndarray:
    """(n, 8) bytes as (n, 9): each byte behind a zero bit."""
    g, out = groups.astype(np.uint16), np.zeros((len(groups), 9), np.uint8)
    for k in range(8):
        out[:, k] |= (g[:, k] >> (k + 1)).astype(np.uint8)
        out[:, k + 1] |= (g[:, k] << (7 - k) & 0xFF).astype(np.uint8)
    return out


def _unpack(packed: np.ndarray) -> np.ndarray:
    p, out = packed.astype(np.uint16), np.zeros((len(packed), 8), np.uint8)
    for k in range(8):
        out[:, k] = ((p[:, k] << (k + 1)) | (p[:, k + 1] >> (7 - k))) & 0xFF
    return out


def _scans(payload: np.ndarray) -> np.ndarray:
    """(blocks, 74): each block's 72 bytes of entropy-coded data and its restart marker."""
    n = len(payload) // 64
    out = np.zeros((n, 74), np.uint8)
    out[:, :72] = _pack(payload.reshape(-1, 8)).reshape(n, 72)
    out[:, 72] = 0xFF
    out[:, 73] = 0xD0 + np.arange(n) % BLOCKS % 8
    return out


def frames_of(payload: bytes) -> tuple[list[bytes], int, int]:
    """(JPEG frames, width, height) of a payload whose length is a multiple of 64."""
    n = len(payload) // 64
    across = min(n, SIDE)
    down = min(-(-n // across), BLOCKS // SIDE)
    per = across * down
    data = np.frombuffer(payload, np.uint8)
    if n % per:
        data = np.concatenate([data, np.zeros(64 * (per - n % per), np.uint8)])
    head, out = _head(8 * across, 8 * down), []
    scans = _scans(data).reshape(-1, per * 74)
    stuffed = bool((scans.reshape(-1, 74)[:, :72] == 0xFF).any())
    for scan in scans:
        if stuffed:
            blocks = scan.reshape(-1, 74)
            body = b"".join(b[:72].tobytes().replace(b"\xff", b"\xff\x00") + bytes((0xFF, 0xD0 + k % 8)) for k, b in enumerate(blocks))[:-2]
        else:
            blocks = scan.reshape(-1, 74)
            blocks[:, 73] = 0xD0 + np.arange(per) % 8
            body = scan.tobytes()[:-2]
        out.append(head + body + b"\xff\xd9")
    return out, 8 * across, 8 * down


def _chunk(tag: bytes, body: bytes) -> bytes:
    return tag + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) % 2)


def encode(payload: bytes, n_bytes: int) -> bytes:
    """An AVI file of ``payload``; ``n_bytes`` (its unpadded length) goes along in a chunk of its own."""
    frames, width, height = frames_of(payload)
    largest = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // RATE, largest * RATE, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1, RATE, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0x47504A4D, width * height * 3, 0, 0, 0, 0)
    hdrl = b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    size = _chunk(b"size", struct.pack("<QQ", n_bytes, len(payload)))
    movi, index, at = [b"movi"], [], 4
    for frame in frames:
        chunk = _chunk(b"00dc", frame)
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(frame)))
        movi.append(chunk)
        at += len(chunk)
    return _chunk(b"RIFF", b"AVI " + _chunk(b"LIST", hdrl) + size + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


def _chunks(data: memoryview, at: int, end: int):
    while at + 8 <= end:
        tag, size = bytes(data[at : at + 4]), struct.unpack_from("<I", data, at + 4)[0]
        if at + 8 + size > end:
            raise ValueError("a RIFF chunk is cut short")
        yield tag, at + 8, size
        at += 8 + size + size % 2


def parse(media: bytes) -> dict:
    """Frames by the file's index, or by walking ``movi`` where it has none:
    {frames, rate, n_bytes, payload_bytes}."""
    data = memoryview(media)
    if len(data) < 12:
        raise ValueError("not an AVI file")
    if bytes(data[:4]) != b"RIFF" or bytes(data[8:12]) != b"AVI ":
        raise ValueError("not an AVI file")
    out: dict = {"frames": [], "rate": float(RATE), "n_bytes": None, "payload_bytes": None}
    movi, index = None, None
    for tag, at, size in _chunks(data, 12, 8 + struct.unpack_from("<I", data, 4)[0]):
        kind = bytes(data[at : at + 4])
        if tag == b"LIST" and kind == b"hdrl":
            for t, a, _ in _chunks(data, at + 4, at + size):
                if t == b"avih":
                    out["rate"] = 1e6 / max(1, struct.unpack_from("<I", data, a)[0])
        elif tag == b"LIST" and kind == b"movi":
            movi = (at, size)
        elif tag == b"idx1":
            index = (at, size)
        elif tag == b"size":
            out["n_bytes"], out["payload_bytes"] = struct.unpack_from("<QQ", data, at)
    if movi is None:
        raise ValueError("the file has no movi list")
    if index is not None:
        rows = [struct.unpack_from("<4sIII", data, a) for a in range(index[0], index[0] + index[1], 16)]
        # offsets count from the list's type, or in some files from the start
        base = movi[0] if not rows or rows[0][2] < movi[0] else 0
        out["frames"] = [data[base + o + 8 : base + o + 8 + n] for t, _, o, n in rows if t[2:] in (b"dc", b"db")]
    else:
        out["frames"] = [data[a : a + n] for t, a, n in _chunks(data, movi[0] + 4, movi[0] + movi[1]) if t[2:] in (b"dc", b"db")]
    return out


# The Huffman tables that JPEG suggests, which motion-JPEG frames may leave out:
# for each table the number of codes of 1 to 16 bits, then the symbols in the order of their codes.
_USUAL = {
    0x00: ("0 1 5 1 1 1 1 1 1 0 0 0 0 0 0 0", "000102030405060708090a0b"),
    0x01: ("0 3 1 1 1 1 1 1 1 1 1 0 0 0 0 0", "000102030405060708090a0b"),
    0x10: (
        "0 2 1 3 3 2 4 3 5 5 4 4 0 0 1 125",
        "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a"
        "434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aa"
        "b2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa",
    ),
    0x11: (
        "0 2 1 2 4 4 3 4 7 5 4 4 0 1 2 119",
        "000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a"
        "434445464748494a535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aa"
        "b2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa",
    ),
}


@dataclass
class Part:
    """One component: sampling factors, quantisation (zigzag order) and (down, across, 64) coefficients (zigzag order)."""

    across: int
    down: int
    table: int
    blocks: np.ndarray = field(default_factory=lambda: np.zeros((0, 0, 64), np.int16))
    quant: np.ndarray = field(default_factory=lambda: np.ones(64, np.int64))


@dataclass
class Frame:
    width: int
    height: int
    parts: list[Part]


def _segments(frame: bytes):
    """(marker, body, scan) of each segment; the scan is the entropy-coded data behind a start of scan."""
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    at = 2
    while at + 1 < len(frame):
        if frame[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = frame[at + 1]
        if marker == 0xFF:  # fill bytes
            at += 1
            continue
        if marker == 0xD9:
            return
        if at + 4 > len(frame):
            raise ValueError("the frame is cut short")
        size = struct.unpack_from(">H", frame, at + 2)[0]
        body, at, scan = frame[at + 4 : at + 2 + size], at + 2 + size, b""
        if marker == 0xDA:
            end = at
            while True:
                end = frame.find(b"\xff", end)
                if end < 0 or end + 1 >= len(frame):
                    end = len(frame)
                    break
                if frame[end + 1] and not 0xD0 <= frame[end + 1] <= 0xD7:
                    break
                end += 2
            scan, at = frame[at:end], end
        yield marker, body, scan


def parse_frame(frame: bytes | memoryview) -> Frame:
    """The quantised coefficients of a baseline frame. What is not one, or is cut short, raises ValueError."""
    frame = bytes(frame)
    out, quants, tables, restart, single = None, {}, {}, 0, 0
    try:
        for marker, body, scan in _segments(frame):
            if marker == 0xC4:
                single += _segment(marker, body) in _SINGLE
                tables.update(_huffman(body))
            elif marker == 0xDB:
                at = 0
                while at < len(body):
                    wide = body[at] >> 4
                    quants[body[at] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, at + 1).astype(np.int64)
                    at += 1 + 64 * (1 + wide)
            elif marker in (0xC0, 0xC1):
                bits, height, width, n = struct.unpack_from(">BHHB", body)
                if bits != 8 or not n or not width or not height:
                    raise ValueError("only frames of 8 bits and a known size")
                parts = [(body[6 + 3 * k], Part(body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k])) for k in range(n)]
                out = Frame(width, height, [p for _, p in parts])
                known = dict(parts)
                most = max(p.across for p in out.parts), max(p.down for p in out.parts)
                grid = -(-width // (8 * most[0])), -(-height // (8 * most[1]))
                for p in out.parts:
                    p.blocks = np.zeros((grid[1] * p.down, grid[0] * p.across, 64), np.int16)
            elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise ValueError("only baseline frames")
            elif marker == 0xDD:
                restart = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                if out is None:
                    raise ValueError("a scan without a frame")
                held = [(known[body[1 + 2 * k]], body[2 + 2 * k]) for k in range(body[0])]
                if len(out.parts) == 1 and single == 2 and restart == 1:
                    held[0][0].blocks = _fast(scan, held[0][0].blocks.shape)
                else:
                    _scan(scan, out, held, tables, restart, grid, most)
    except (IndexError, KeyError, struct.error) as e:
        raise ValueError("the frame is damaged") from e
    if out is None:
        raise ValueError("no frame")
    for p in out.parts:
        p.quant = quants.get(p.table, p.quant)
    return out


def _fast(scan: bytes, shape: tuple[int, ...]) -> np.ndarray:
    n = shape[0] * shape[1]
    if len(scan) != 74 * n - 2:
        scan = scan.replace(b"\xff\x00", b"\xff")
    if len(scan) != 74 * n - 2:
        raise ValueError("a scan is cut short")
    blocks = np.frombuffer(scan + b"\xff\xd0", np.uint8).reshape(n, 74)
    raw = _unpack(np.ascontiguousarray(blocks[:, :72]).reshape(-1, 9)).reshape(n, 64).astype(np.int16)
    return np.where(raw >= 128, raw, raw - 255).reshape(shape)


def decode_frame(frame: bytes | memoryview) -> np.ndarray:
    """(blocks, 64) quantised coefficients in zigzag order of a frame's first component."""
    return parse_frame(frame).parts[0].blocks.reshape(-1, 64)


def _transform() -> np.ndarray:
    """(64 coefficients in zigzag order, 64 samples): the inverse transform in units of 2 ** -13."""
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    c = np.where(k == 0, np.sqrt(0.5), 1.0) / 2 * np.cos((2 * x + 1) * k * np.pi / 16)
    whole = np.einsum("ux,vy->uvxy", c, c).reshape(64, 64)
    return np.round(whole[ZIGZAG] * 8192)


_INVERSE = _transform()


def pixels(frame: Frame, part: int = 0) -> np.ndarray:
    """(height, width) samples 0 to 255 of a component, the first of which is luma.

    Products and sums are whole numbers below 2**53, so their order does not matter."""
    p = frame.parts[part]
    down, across = p.blocks.shape[:2]
    raw = (p.blocks.reshape(-1, 64) * p.quant.astype(np.float64)) @ _INVERSE
    raw += 8192 * 128 + 4096
    plane = np.clip(np.floor(raw * (1 / 8192)), 0, 255).astype(np.uint8).reshape(down, across, 8, 8).transpose(0, 2, 1, 3).reshape(down * 8, across * 8)
    most = max(q.across for q in frame.parts), max(q.down for q in frame.parts)
    return plane[: -(-frame.height * p.down // most[1]), : -(-frame.width * p.across // most[0])]


def _huffman(body: bytes) -> dict:
    """{class and number: (number of codes of each length, symbols)}."""
    out, at = {}, 0
    while at < len(body):
        counts = body[at + 1 : at + 17]
        out[body[at]] = (counts, body[at + 17 : at + 17 + sum(counts)])
        at += 17 + sum(counts)
    return out


@lru_cache(maxsize=16)
def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """65536 (bits, symbol) by the next 16 bits; bits 0 where no code fits."""
    table, code, k = np.zeros((65536, 2), np.int64), 0, 0
    for length, many in enumerate(counts, 1):
        for _ in range(many):
            table[code << (16 - length) : (code + 1) << (16 - length)] = length, symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return table


def _usual(key: int) -> tuple[bytes, bytes]:
    counts, symbols = _USUAL[key]
    return bytes(map(int, counts.split())), bytes.fromhex(symbols)


def _scan(scan: bytes, frame: Frame, held: list, tables: dict, restart: int, grid: tuple[int, int], most: tuple[int, int]) -> None:
    """Decode a scan into the blocks of its components."""
    tables = {key: _lookup(*(tables.get(key) or _usual(key))) for key in {0x00 | t >> 4 for _, t in held} | {0x10 | t & 15 for _, t in held}}
    if len(held) == 1:  # a scan of one component has its blocks alone, without padding
        p = held[0][0]
        wide, tall = -(-frame.width * p.across // (8 * most[0])), -(-frame.height * p.down // (8 * most[1]))
        units = [[(0, r, c)] for r in range(tall) for c in range(wide)]
    else:
        inner = [(k, r, c) for k, (p, _) in enumerate(held) for r in range(p.down) for c in range(p.across)]
        units = [[(k, y * held[k][0].down + r, x * held[k][0].across + c) for k, r, c in inner] for y in range(grid[1]) for x in range(grid[0])]
    parts, begin, at = [], 0, 0
    while (at := scan.find(b"\xff", at)) >= 0:  # restart markers part the scan
        if at + 1 < len(scan) and 0xD0 <= scan[at + 1] <= 0xD7:
            parts.append(scan[begin:at])
            begin = at + 2
        at += 2
    parts.append(scan[begin:])
    step = restart or len(units)
    if len(parts) < -(-len(units) // step):
        raise ValueError("a scan is cut short")
    for n, first in enumerate(range(0, len(units), step)):
        bits = _Bits(parts[n].replace(b"\xff\x00", b"\xff"))
        pred = [0] * len(held)
        for unit in units[first : first + step]:
            for k, row, column in unit:
                p, t = held[k]
                block = p.blocks[row, column]
                pred[k] += bits.amplitude(bits.symbol(tables[t >> 4]))
                block[0] = pred[k]
                at, ac = 1, tables[0x10 | t & 15]
                while at < 64:
                    run, size = divmod(bits.symbol(ac), 16)
                    if size == 0 and run < 15:
                        break
                    at += run
                    if size:
                        block[at] = bits.amplitude(size)
                    at += 1


class _Bits:
    """A scan's bits; ones follow the last one, for at most a code's length."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data + b"\xff" * 8, 0, 8 * len(data) + 16

    def _next(self, n: int) -> int:
        byte = self.at >> 3
        if self.at + n > self.end:
            raise ValueError("a scan is cut short")
        return int.from_bytes(self.data[byte : byte + 4], "big") >> (32 - n - (self.at & 7)) & ((1 << n) - 1)

    def symbol(self, table: np.ndarray) -> int:
        byte = self.at >> 3
        if self.at > self.end:
            raise ValueError("a scan is cut short")
        length, value = table[int.from_bytes(self.data[byte : byte + 4], "big") >> (16 - (self.at & 7)) & 0xFFFF]
        if not length:
            raise ValueError("a code is not in the table")
        self.at += int(length)
        return int(value)

    def amplitude(self, size: int) -> int:
        value = self._next(size) if size else 0
        self.at += size
        return value if not size or value >> (size - 1) else value - (1 << size) + 1


def encode_coefficients(parts: list[tuple[int, int, np.ndarray]], width: int, height: int, quant: int = 1, usual: bool = False) -> bytes:
    """A baseline frame from components (across, down, (rows, columns, 64) coefficients
    in zigzag order), with generic tables in which every symbol has a code of eight
    bits, or without tables, coded by the usual ones."""
    symbols = [r << 4 | s for r in range(16) for s in range(12) if s or r in (0, 15)]
    codes = {(kind, s): (8, k) for kind in (0, 1) for k, s in enumerate(symbols)}
    if usual:
        codes = {}
        for kind, key in ((0, 0x00), (1, 0x10)):
            counts, listed, code, k = *_USUAL[key], 0, 0
            listed = bytes.fromhex(listed)
            for length, many in enumerate(map(int, counts.split()), 1):
                for _ in range(many):
                    codes[kind, listed[k]] = (length, code)
                    code, k = code + 1, k + 1
                code <<= 1
    table = bytes([0] * 7 + [len(symbols)] + [0] * 8) + bytes(symbols)
    bits: list[int] = []

    def put(length, value):
        bits.extend(value >> (length - 1 - k) & 1 for k in range(length))

    def amplitude(v):
        size = int(abs(v)).bit_length()
        return size, int(v) if v >= 0 else int(v) + (1 << size) - 1

    def block_of(block, pred):
        size, value = amplitude(int(block[0]) - pred)
        put(*codes[0, size])
        put(size, value)
        run, last = 0, np.flatnonzero(block[1:])
        for k in range(1, (last[-1] + 2) if len(last) else 1):
            if not block[k]:
                run += 1
                continue
            while run > 15:
                put(*codes[1, 0xF0])
                run -= 16
            size, value = amplitude(block[k])
            put(*codes[1, run << 4 | size])
            put(size, value)
            run = 0
        if not len(last) or last[-1] < 62:
            put(*codes[1, 0])
        return int(block[0])

    pred = [0] * len(parts)
    down, across = parts[0][2].shape[0] // parts[0][1], parts[0][2].shape[1] // parts[0][0]
    for y in range(down):
        for x in range(across):
            for k, (h, v, blocks) in enumerate(parts):
                for r in range(v):
                    for c in range(h):
                        pred[k] = block_of(blocks[y * v + r, x * h + c], pred[k])
    bits += [1] * (-len(bits) % 8)
    scan = np.packbits(np.array(bits, np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")
    shape = b"".join(bytes((k + 1, h << 4 | v, 0)) for k, (h, v, _) in enumerate(parts))
    head = b"\xff\xd8" + _segment(0xDB, b"\x00" + bytes([quant]) * 64) + _segment(0xC0, struct.pack(">BHHB", 8, height, width, len(parts)) + shape)
    tables = b"" if usual else _segment(0xC4, b"\x00" + table) + _segment(0xC4, b"\x10" + table)
    scans = bytes([len(parts)]) + b"".join(bytes((k + 1, 0)) for k in range(len(parts))) + b"\x00\x3f\x00"
    return head + tables + _segment(0xDA, scans) + scan + b"\xff\xd9"
