"""Baseline JPEG: Huffman-coded sequential decoding with restarts and bilinear chroma, and an encoder. Transforms run over
all blocks of a component at once."""

from __future__ import annotations

import struct

import numpy as np

from . import CodecError, check_size, damaged, need, to_rgba, unsupported

SIDE = 65_535
_U = np.arange(8)
#: Orthonormal DCT matrix.
DCT = np.sqrt(np.where(_U == 0, 1, 2) / 8)[:, None] * np.cos((2 * _U[None, :] + 1) * _U[:, None] * np.pi / 16)


def _zigzag() -> np.ndarray:
    """Natural positions in zigzag order."""
    cells = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return np.array([y * 8 + x for y, x in cells])


ZIGZAG = _zigzag()
# The standard's example quantisation and Huffman tables (counts by code length, then symbols).
# fmt: off
LUMA_Q = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17,
    22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78,
    87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
CHROMA_Q = (
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
)
DC_LUMA_COUNTS = (
    0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0,
)
DC_LUMA = (
    0x00, 0x01, 0x02, 0x03, 0x04, 0x05, 0x06, 0x07, 0x08, 0x09, 0x0A, 0x0B,
)
DC_CHROMA_COUNTS = (
    0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0,
)
DC_CHROMA = (
    0x00, 0x01, 0x02, 0x03, 0x04, 0x05, 0x06, 0x07, 0x08, 0x09, 0x0A, 0x0B,
)
AC_LUMA_COUNTS = (
    0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125,
)
AC_LUMA = (
    0x01, 0x02, 0x03, 0x00, 0x04, 0x11, 0x05, 0x12, 0x21, 0x31, 0x41, 0x06, 0x13, 0x51, 0x61, 0x07, 0x22,
    0x71, 0x14, 0x32, 0x81, 0x91, 0xA1, 0x08, 0x23, 0x42, 0xB1, 0xC1, 0x15, 0x52, 0xD1, 0xF0, 0x24, 0x33,
    0x62, 0x72, 0x82, 0x09, 0x0A, 0x16, 0x17, 0x18, 0x19, 0x1A, 0x25, 0x26, 0x27, 0x28, 0x29, 0x2A, 0x34,
    0x35, 0x36, 0x37, 0x38, 0x39, 0x3A, 0x43, 0x44, 0x45, 0x46, 0x47, 0x48, 0x49, 0x4A, 0x53, 0x54, 0x55,
    0x56, 0x57, 0x58, 0x59, 0x5A, 0x63, 0x64, 0x65, 0x66, 0x67, 0x68, 0x69, 0x6A, 0x73, 0x74, 0x75, 0x76,
    0x77, 0x78, 0x79, 0x7A, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8A, 0x92, 0x93, 0x94, 0x95, 0x96,
    0x97, 0x98, 0x99, 0x9A, 0xA2, 0xA3, 0xA4, 0xA5, 0xA6, 0xA7, 0xA8, 0xA9, 0xAA, 0xB2, 0xB3, 0xB4, 0xB5,
    0xB6, 0xB7, 0xB8, 0xB9, 0xBA, 0xC2, 0xC3, 0xC4, 0xC5, 0xC6, 0xC7, 0xC8, 0xC9, 0xCA, 0xD2, 0xD3, 0xD4,
    0xD5, 0xD6, 0xD7, 0xD8, 0xD9, 0xDA, 0xE1, 0xE2, 0xE3, 0xE4, 0xE5, 0xE6, 0xE7, 0xE8, 0xE9, 0xEA, 0xF1,
    0xF2, 0xF3, 0xF4, 0xF5, 0xF6, 0xF7, 0xF8, 0xF9, 0xFA,
)
AC_CHROMA_COUNTS = (
    0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119,
)
AC_CHROMA = (
    0x00, 0x01, 0x02, 0x03, 0x11, 0x04, 0x05, 0x21, 0x31, 0x06, 0x12, 0x41, 0x51, 0x07, 0x61, 0x71, 0x13,
    0x22, 0x32, 0x81, 0x08, 0x14, 0x42, 0x91, 0xA1, 0xB1, 0xC1, 0x09, 0x23, 0x33, 0x52, 0xF0, 0x15, 0x62,
    0x72, 0xD1, 0x0A, 0x16, 0x24, 0x34, 0xE1, 0x25, 0xF1, 0x17, 0x18, 0x19, 0x1A, 0x26, 0x27, 0x28, 0x29,
    0x2A, 0x35, 0x36, 0x37, 0x38, 0x39, 0x3A, 0x43, 0x44, 0x45, 0x46, 0x47, 0x48, 0x49, 0x4A, 0x53, 0x54,
    0x55, 0x56, 0x57, 0x58, 0x59, 0x5A, 0x63, 0x64, 0x65, 0x66, 0x67, 0x68, 0x69, 0x6A, 0x73, 0x74, 0x75,
    0x76, 0x77, 0x78, 0x79, 0x7A, 0x82, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8A, 0x92, 0x93, 0x94,
    0x95, 0x96, 0x97, 0x98, 0x99, 0x9A, 0xA2, 0xA3, 0xA4, 0xA5, 0xA6, 0xA7, 0xA8, 0xA9, 0xAA, 0xB2, 0xB3,
    0xB4, 0xB5, 0xB6, 0xB7, 0xB8, 0xB9, 0xBA, 0xC2, 0xC3, 0xC4, 0xC5, 0xC6, 0xC7, 0xC8, 0xC9, 0xCA, 0xD2,
    0xD3, 0xD4, 0xD5, 0xD6, 0xD7, 0xD8, 0xD9, 0xDA, 0xE2, 0xE3, 0xE4, 0xE5, 0xE6, 0xE7, 0xE8, 0xE9, 0xEA,
    0xF2, 0xF3, 0xF4, 0xF5, 0xF6, 0xF7, 0xF8, 0xF9, 0xFA,
)
# fmt: on


def is_jpeg(data: bytes) -> bool:
    return data[:2] == b"\xff\xd8"


def segments(data: bytes):
    """(marker, body, position after it) up to the first scan's end of header; the scan's data follow at the position."""
    if not is_jpeg(data):
        raise damaged("not a JPEG")
    at = 2
    while at < len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        while at < len(data) and data[at] == 0xFF:
            at += 1
        if at >= len(data):
            return
        marker = data[at]
        at += 1
        if marker == 0xD9:
            return
        if marker == 0 or marker == 1 or 0xD0 <= marker <= 0xD8:
            continue
        (size,) = struct.unpack(">H", need(data, at, 2))
        if size < 2:
            raise damaged("a segment is too short")
        body = need(data, at + 2, size - 2)
        at += size
        jump = yield marker, body, at
        if jump:
            at = jump


def dimensions(data: bytes) -> tuple[int, int]:
    """Of any kind of frame."""
    for marker, body, _ in segments(data):
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", need(body, 1, 4))
            return w, h
    raise damaged("no frame")


def _lookup(counts: list[int], symbols: bytes) -> np.ndarray:
    """For every 16 bits: code length << 8 | symbol; 0 where no code fits."""
    table = np.zeros(65536, np.int32)
    code = at = 0
    for size, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            first = code << (16 - size)
            if first >= 65536:
                raise damaged("wrong Huffman table")
            table[first : first + (1 << (16 - size))] = size << 8 | s
            code += 1
        at += n
        code <<= 1
    return table


class _Bits:
    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.value, self.held = data, 0, 0, 0

    def fill(self) -> None:
        part = self.data[self.at : self.at + 8]
        self.at += 8
        self.value = self.value << 64 | int.from_bytes(part.ljust(8, b"\0"), "big")
        self.held += 64
        if self.at > len(self.data) + 64:
            raise damaged("the scan ends early")

    def symbol(self, table) -> int:
        if self.held < 16:
            self.fill()
        hit = table[(self.value >> (self.held - 16)) & 0xFFFF]
        if not hit:
            raise damaged("wrong Huffman code")
        self.held -= hit >> 8
        self.value &= (1 << self.held) - 1
        return hit & 255

    def extend(self, size: int) -> int:
        if not size:
            return 0
        if self.held < size:
            self.fill()
        self.held -= size
        v = self.value >> self.held
        self.value &= (1 << self.held) - 1
        return v if v >> (size - 1) else v - (1 << size) + 1


def decode(data: bytes) -> np.ndarray:
    quant: dict[int, np.ndarray] = {}
    tables: dict[int, list[int]] = {}
    frame = None
    every = 0
    walk = segments(data)
    item = next(walk, None)
    while item is not None:
        marker, body, at = item
        jump = None
        if marker == 0xDB:
            _quantisers(body, quant)
        elif marker == 0xC4:
            while body:
                counts = list(need(body, 1, 16))
                tables[body[0]] = _lookup(counts, need(body, 17, sum(counts))).tolist()
                body = body[17 + sum(counts) :]
        elif marker == 0xDD:
            (every,) = struct.unpack(">H", need(body, 0, 2))
        elif marker in (0xC0, 0xC1):
            frame = _frame(body)
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise unsupported("only baseline frames are supported")
        elif marker == 0xDA:
            if frame is None:
                raise damaged("a scan before the frame")
            jump = _scan(data, at, body, frame, tables, every)
        try:
            item = walk.send(jump) if jump else next(walk)
        except StopIteration:
            item = None
    if frame is None or not frame["done"]:
        raise damaged("no image")
    return _render(frame, quant)


def _quantisers(body: bytes, quant: dict) -> None:
    while body:
        wide, n = body[0] >> 4, body[0] & 15
        size = 128 if wide else 64
        table = np.frombuffer(need(body, 1, size), ">u2" if wide else np.uint8).astype(np.float64)
        if not table.all():
            raise damaged("a quantiser is zero")
        quant[n] = table
        body = body[1 + size :]


def _frame(body: bytes) -> dict:
    depth, h, w, n = struct.unpack(">BHHB", need(body, 0, 6))
    if depth != 8:
        raise unsupported("only 8 bits are supported")
    if n == 4:
        raise unsupported("CMYK isn't supported")
    if n not in (1, 3):
        raise damaged("wrong number of components")
    check_size(w, h, SIDE)
    parts = []
    for i in range(n):
        ident, sampling, q = need(body, 6 + 3 * i, 3)
        if not 1 <= sampling >> 4 <= 4 or not 1 <= sampling & 15 <= 4:
            raise damaged("wrong sampling")
        parts.append({"id": ident, "h": sampling >> 4, "v": sampling & 15, "q": q})
    top_h, top_v = max(p["h"] for p in parts), max(p["v"] for p in parts)
    across, down = -(-w // (8 * top_h)), -(-h // (8 * top_v))
    for p in parts:
        p["across"], p["down"] = across * p["h"], down * p["v"]
        p["blocks"] = np.zeros((p["down"] * p["across"], 64), np.int32)
        p["size"] = (-(-w * p["h"] // top_h), -(-h * p["v"] // top_v))
    return {"width": w, "height": h, "parts": parts, "across": across, "down": down, "h": top_h, "v": top_v, "done": set()}


def _scan(data: bytes, at: int, body: bytes, frame: dict, tables: dict, every: int) -> int:
    n = need(body, 0, 1)[0]
    chosen = []
    for i in range(n):
        ident, t = need(body, 1 + 2 * i, 2)
        part = next((p for p in frame["parts"] if p["id"] == ident), None)
        if part is None or t >> 4 not in tables or 16 + (t & 15) not in tables:
            raise damaged("wrong scan header")
        chosen.append((part, tables[t >> 4], tables[16 + (t & 15)]))
        frame["done"].add(ident)
    end = at
    pieces, start = [], at
    while True:  # up to a marker that isn't a restart
        end = data.find(b"\xff", end)
        if end < 0 or end + 1 >= len(data):
            end = len(data)
            break
        follow = data[end + 1]
        if follow == 0 or follow == 0xFF:
            end += 2 if follow == 0 else 1
        elif 0xD0 <= follow <= 0xD7:
            pieces.append(data[start:end])
            end += 2
            start = end
        else:
            break
    pieces.append(data[start:end])
    runs = [p.replace(b"\xff\x00", b"\xff") for p in pieces]
    if n == 1:  # one component: its own blocks, row by row
        part, dc, ac = chosen[0]
        w, h = -(-part["size"][0] // 8), -(-part["size"][1] // 8)
        units = [[(part, dc, ac, y * part["across"] + x, 0)] for y in range(h) for x in range(w)]
    else:
        units = [[(p, dc, ac, (my * p["v"] + v) * p["across"] + mx * p["h"] + h, j) for j, (p, dc, ac) in enumerate(chosen) for v in range(p["v"]) for h in range(p["h"])] for my in range(frame["down"]) for mx in range(frame["across"])]
    step = every or len(units)
    for k, first in enumerate(range(0, len(units), step)):
        if k >= len(runs):
            raise damaged("the scan ends early")
        bits, last = _Bits(runs[k]), [0] * len(chosen)
        for unit in units[first : first + step]:
            for part, dc, ac, place, j in unit:
                last[j] += bits.extend(bits.symbol(dc))
                row = part["blocks"][place]
                row[0] = last[j]
                i = 1
                while i < 64:
                    s = bits.symbol(ac)
                    if not s & 15:
                        if s != 0xF0:
                            break
                        i += 16
                        continue
                    i += s >> 4
                    if i > 63:
                        raise damaged("too many coefficients")
                    row[i] = bits.extend(s & 15)
                    i += 1
    return end


def _plane(part: dict, quant: dict) -> np.ndarray:
    if part["q"] not in quant:
        raise damaged("a quantiser is missing")
    natural = np.zeros((len(part["blocks"]), 64))
    natural[:, ZIGZAG] = part["blocks"] * quant[part["q"]]
    space = np.einsum("ku,nkl,lv->nuv", DCT, natural.reshape(-1, 8, 8), DCT, optimize=True) + 128
    plane = space.reshape(part["down"], part["across"], 8, 8).swapaxes(1, 2).reshape(part["down"] * 8, part["across"] * 8)
    w, h = part["size"]
    return np.clip(np.floor(plane[:h, :w] + 0.5), 0, 255)


def _stretch(plane: np.ndarray, size: int, ratio: float, axis: int) -> np.ndarray:
    """Centre-aligned linear interpolation along an axis."""
    at = np.clip((np.arange(size) + 0.5) * ratio - 0.5, 0, plane.shape[axis] - 1)
    low = np.floor(at).astype(int)
    high = np.minimum(low + 1, plane.shape[axis] - 1)
    part = (at - low).reshape((-1, 1) if axis == 0 else (1, -1))
    return plane.take(low, axis) * (1 - part) + plane.take(high, axis) * part


def _render(frame: dict, quant: dict) -> np.ndarray:
    w, h = frame["width"], frame["height"]
    planes = []
    for p in frame["parts"]:
        plane = _plane(p, quant)
        if p["v"] != frame["v"]:
            plane = _stretch(plane, h, p["v"] / frame["v"], 0)
        if p["h"] != frame["h"]:
            plane = _stretch(plane, w, p["h"] / frame["h"], 1)
        planes.append(plane[:h, :w])
    out = np.full((h, w, 4), 255, np.uint8)
    if len(planes) == 1:
        out[..., :3] = planes[0][..., None].astype(np.uint8)
        return out
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2)
    out[..., :3] = np.clip(np.floor(rgb + 0.5), 0, 255).astype(np.uint8)
    return out


def _scaled(table: tuple[int, ...], quality: int) -> np.ndarray:
    if not 1 <= quality <= 100:
        raise CodecError("invalid_input", "quality must be 1 to 100")
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(table, np.int64) * scale + 50) // 100, 1, 255)


def _codes(counts: tuple[int, ...], symbols: tuple[int, ...]) -> dict[int, tuple[int, int]]:
    out, code, at = {}, 0, 0
    for size, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            out[s] = (code, size)
            code += 1
        at += n
        code <<= 1
    return out


class _Writer:
    def __init__(self) -> None:
        self.out, self.value, self.held = bytearray(), 0, 0

    def put(self, value: int, size: int) -> None:
        self.value = self.value << size | value
        self.held += size
        while self.held >= 8:
            self.held -= 8
            byte = self.value >> self.held
            self.out.append(byte)
            if byte == 255:
                self.out.append(0)
            self.value &= (1 << self.held) - 1

    def number(self, v: int) -> int:
        return abs(v).bit_length()


def _blocks(plane: np.ndarray, table: np.ndarray, across: int, down: int) -> np.ndarray:
    h, w = plane.shape
    padded = np.pad(plane, ((0, down * 8 - h), (0, across * 8 - w)), mode="edge") - 128
    space = padded.reshape(down, 8, across, 8).swapaxes(1, 2)
    freq = np.einsum("uk,yxkl,vl->yxuv", DCT, space, DCT, optimize=True).reshape(down, across, 64) / table
    return (np.sign(freq) * np.floor(np.abs(freq) + 0.5)).astype(np.int64)[..., ZIGZAG]


def encode(pixels: np.ndarray, quality: int = 75, sampling: str = "420") -> bytes:
    """sampling: 420, 444 or gray. Alpha is dropped."""
    pixels = to_rgba(pixels)
    height, width, _ = pixels.shape
    if width > SIDE or height > SIDE or sampling not in ("420", "444", "gray"):
        raise CodecError("invalid_input", "wrong size or sampling")
    luma, chroma = _scaled(LUMA_Q, quality), _scaled(CHROMA_Q, quality)
    r, g, b = (pixels[..., i].astype(np.float64) for i in range(3))
    planes = [0.299 * r + 0.587 * g + 0.114 * b]
    if sampling != "gray":
        planes += [128 - 0.168736 * r - 0.331264 * g + 0.5 * b, 128 + 0.5 * r - 0.418688 * g - 0.081312 * b]
    k = 2 if sampling == "420" else 1
    if k == 2:
        planes[1:] = [np.pad(p, ((0, height % 2), (0, width % 2)), mode="edge").reshape(-(-height // 2), 2, -(-width // 2), 2).mean(axis=(1, 3)) for p in planes[1:]]
    across, down = -(-width // (8 * k)), -(-height // (8 * k))
    parts = [(_blocks(planes[0], luma, across * k, down * k), k, 0)] + [(_blocks(p, chroma, across, down), 1, 1) for p in planes[1:]]
    segment = lambda marker, body: bytes([255, marker]) + struct.pack(">H", len(body) + 2) + body
    out = b"\xff\xd8" + segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
    used = 1 if sampling == "gray" else 2
    for i, table in enumerate((luma, chroma)[:used]):
        out += segment(0xDB, bytes([i]) + bytes(table[ZIGZAG].tolist()))
    head = struct.pack(">BHHB", 8, height, width, len(parts))
    out += segment(0xC0, head + b"".join(bytes([i + 1, f << 4 | f, q]) for i, (_, f, q) in enumerate(parts)))
    codes = []
    tables = ((DC_LUMA_COUNTS, DC_LUMA, AC_LUMA_COUNTS, AC_LUMA), (DC_CHROMA_COUNTS, DC_CHROMA, AC_CHROMA_COUNTS, AC_CHROMA))
    for i, (dc_counts, dc, ac_counts, ac) in enumerate(tables[:used]):
        for kind, counts, symbols in ((0, dc_counts, dc), (16, ac_counts, ac)):
            out += segment(0xC4, bytes([kind + i, *counts, *symbols]))
        codes.append((_codes(dc_counts, dc), _codes(ac_counts, ac)))
    out += segment(0xDA, bytes([len(parts)]) + b"".join(bytes([i + 1, q * 17]) for i, (_, _, q) in enumerate(parts)) + b"\0\x3f\0")
    return out + _entropy(parts, codes, across, down) + b"\xff\xd9"


def _entropy(parts, codes, across: int, down: int) -> bytes:
    bits, last = _Writer(), [0] * len(parts)
    for my in range(down):
        for mx in range(across):
            for j, (blocks, f, q) in enumerate(parts):
                dc, ac = codes[q]
                for v in range(f):
                    for h in range(f):
                        row = blocks[my * f + v, mx * f + h]
                        diff, last[j] = int(row[0]) - last[j], int(row[0])
                        _put(bits, dc, 0, diff)
                        before = 0
                        for i in (np.flatnonzero(row[1:]) + 1).tolist():
                            gap = i - before - 1
                            while gap > 15:
                                bits.put(*ac[0xF0])
                                gap -= 16
                            _put(bits, ac, gap << 4, int(row[i]))
                            before = i
                        if before < 63:
                            bits.put(*ac[0])
    if bits.held:
        bits.put((1 << (8 - bits.held)) - 1, 8 - bits.held)
    return bytes(bits.out)


def _put(bits: _Writer, codes: dict, run: int, value: int) -> None:
    size = abs(value).bit_length()
    bits.put(*codes[run | size])
    if size:
        bits.put(value if value > 0 else value + (1 << size) - 1, size)


def exif(data: bytes) -> dict:
    """orientation, date_taken, camera, exposure from the Exif segment; missing ones are None."""
    out = dict.fromkeys(("orientation", "date_taken", "camera", "exposure"))
    if not is_jpeg(data):
        return out
    try:
        body = next((b[6:] for m, b, _ in segments(data) if m == 0xE1 and b[:6] == b"Exif\0\0"), None)
        if body is None:
            return out
        e = {b"II": "<", b"MM": ">"}[body[:2]]
        read = lambda at: _tags(body, at, e)
        first = read(struct.unpack(e + "I", need(body, 4, 4))[0])
        inner = read(first[0x8769]) if 0x8769 in first else {}
    except (CodecError, KeyError, struct.error):
        return out
    out["orientation"] = first.get(0x0112)
    out["date_taken"] = inner.get(0x9003) or first.get(0x0132)
    out["camera"] = " ".join(x for x in (first.get(0x010F), first.get(0x0110)) if x) or None
    if isinstance(t := inner.get(0x829A), tuple) and t[1]:
        out["exposure"] = f"{t[0]}/{t[1]}"
    return out


def _tags(body: bytes, at: int, e: str) -> dict:
    (n,) = struct.unpack(e + "H", need(body, at, 2))
    out = {}
    for i in range(n):
        tag, kind, count = struct.unpack(e + "HHI", need(body, at + 2 + 12 * i, 8))
        raw = need(body, at + 10 + 12 * i, 4)
        where = struct.unpack(e + "I", raw)[0]
        if kind == 2:
            text = raw[:count] if count <= 4 else need(body, where, count)
            out[tag] = text.split(b"\0")[0].decode("utf-8", "replace").strip()
        elif kind == 3:
            out[tag] = struct.unpack(e + "H", raw[:2])[0]
        elif kind == 4:
            out[tag] = where
        elif kind == 5:
            out[tag] = struct.unpack(e + "II", need(body, where, 8))
    return out
