"""PNG: all colour types and depths, Adam7, transparency; encoder for RGBA."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from . import check_size, damaged, need, to_rgba

SIGNATURE = b"\x89PNG\r\n\x1a\n"
SIDE, CHUNK = 1_000_000, 128 << 20
# Channels by colour type, depths by colour type, and the seven passes (x0, y0, dx, dy).
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def is_png(data: bytes) -> bool:
    return data[:8] == SIGNATURE


def dimensions(data: bytes) -> tuple[int, int]:
    if not is_png(data) or data[12:16] != b"IHDR":
        raise damaged("not a PNG")
    return struct.unpack(">II", need(data, 16, 8))


def _chunks(data: bytes):
    at = 8
    while True:
        (size,) = struct.unpack(">I", need(data, at, 4))
        if size > CHUNK:
            raise damaged("a chunk is too long")
        kind, body = need(data, at + 4, 4), need(data, at + 8, size)
        if struct.unpack(">I", need(data, at + 8 + size, 4))[0] != zlib.crc32(kind + body):
            raise damaged("a chunk's checksum is wrong")
        yield kind, body
        at += 12 + size
        if kind == b"IEND":
            return


def _unfilter(raw: np.ndarray, rows: int, stride: int, unit: int) -> np.ndarray:
    """Scanlines without their filters; unit: bytes of a pixel, at least 1."""
    lines = raw.reshape(rows, stride + 1)
    out = np.zeros((rows + 1, stride), np.uint8)
    for y in range(rows):
        kind, line, up = int(lines[y, 0]), lines[y, 1:], out[y]
        if kind == 0:
            out[y + 1] = line
        elif kind == 1:
            for c in range(unit):
                out[y + 1, c::unit] = np.cumsum(line[c::unit], dtype=np.uint8)
        elif kind == 2:
            out[y + 1] = line + up
        elif kind in (3, 4):
            row, above = bytearray(line.tobytes()), up.tolist()
            for i in range(stride):
                a, b = row[i - unit] if i >= unit else 0, above[i]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    c = above[i - unit] if i >= unit else 0
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else (b if pb <= pc else c)
                row[i] = (row[i] + guess) & 255
            out[y + 1] = np.frombuffer(row, np.uint8)
        else:
            raise damaged("unknown scanline filter")
    return out[1:]


def _samples(lines: np.ndarray, width: int, channels: int, depth: int) -> np.ndarray:
    rows = len(lines)
    if depth == 16:
        return lines.reshape(rows, -1).copy().view(">u2").astype(np.int32).reshape(rows, width, channels)
    if depth == 8:
        return lines.astype(np.int32).reshape(rows, width, channels)
    bits = np.unpackbits(lines, axis=1).reshape(rows, -1, depth)
    value = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(axis=2)
    return value[:, :width].astype(np.int32).reshape(rows, width, 1)


def decode(data: bytes) -> np.ndarray:
    """height x width x 4."""
    if not is_png(data):
        raise damaged("not a PNG")
    header = palette = trns = None
    parts: list[bytes] = []
    for kind, body in _chunks(data):
        if header is None and kind != b"IHDR":
            raise damaged("the header must come first")
        if kind == b"IHDR":
            if header is not None or len(body) != 13:
                raise damaged("wrong header")
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            if parts or len(body) % 3 or not 3 <= len(body) <= 768:
                raise damaged("wrong palette")
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            trns = body
        elif kind == b"IDAT":
            parts.append(body)
        elif kind != b"IEND" and not kind[0] & 32:
            raise damaged("unknown critical chunk")
    width, height, depth, color, method, filtering, interlace = header
    if depth not in DEPTHS.get(color, ()) or method or filtering or interlace > 1:
        raise damaged("wrong header")
    check_size(width, height, SIDE)
    if color == 3 and palette is None:
        raise damaged("the palette is missing")
    channels = CHANNELS[color]
    bits = channels * depth
    passes = PASSES if interlace else ((0, 0, 1, 1),)
    sizes = [(max(0, -(-(width - x) // dx)), max(0, -(-(height - y) // dy))) for x, y, dx, dy in passes]
    sizes = [(w, h) if w and h else (0, 0) for w, h in sizes]
    expected = sum(h * (1 + (w * bits + 7) // 8) for w, h in sizes)
    try:
        stream = zlib.decompressobj()
        raw = stream.decompress(b"".join(parts), expected + 1)
    except zlib.error as error:
        raise damaged(str(error)) from error
    if len(raw) != expected or stream.unused_data or not (stream.eof or stream.decompress(stream.unconsumed_tail, 1) == b"" and stream.eof):
        raise damaged("the pixel data has the wrong length")
    flat, at = np.frombuffer(raw, np.uint8), 0
    grid = np.zeros((height, width, channels), np.int32)
    for (w, h), (x, y, dx, dy) in zip(sizes, passes, strict=True):
        if w:
            stride = (w * bits + 7) // 8
            lines = _unfilter(flat[at : at + h * (stride + 1)], h, stride, max(1, bits // 8))
            at += h * (stride + 1)
            grid[y::dy, x::dx] = _samples(lines, w, channels, depth)
    return _expand(grid, color, depth, palette, trns)


def _expand(grid: np.ndarray, color: int, depth: int, palette, trns) -> np.ndarray:
    height, width, _ = grid.shape
    out = np.full((height, width, 4), 255, np.uint8)
    if color == 3:
        if int(grid.max()) >= len(palette):
            raise damaged("a pixel is beyond the palette")
        out[..., :3] = palette[grid[..., 0]]
        if trns:
            alpha = np.full(256, 255, np.uint8)
            alpha[: len(trns)] = np.frombuffer(trns[:256], np.uint8)
            out[..., 3] = alpha[grid[..., 0]]
        return out
    top = (1 << depth) - 1
    scaled = grid if depth == 8 else (grid * 255 + (32767 if depth == 16 else top // 2)) // top
    out[..., :3] = scaled[..., :3] if color in (2, 6) else scaled[..., :1]
    if color in (4, 6):
        out[..., 3] = scaled[..., -1]
    elif trns:
        key = np.frombuffer(need(trns, 0, 2 * grid.shape[2]), ">u2").astype(np.int32) & top
        out[..., 3][(grid == key).all(axis=2)] = 0
    return out


def encode(pixels: np.ndarray) -> bytes:
    """RGBA, each row with the filter of the least sum of absolute differences."""
    pixels = to_rgba(pixels)
    height, width, _ = pixels.shape
    lines = pixels.reshape(height, width * 4)
    left = np.pad(lines, ((0, 0), (4, 0)))[:, :-4]
    up = np.vstack([np.zeros((1, width * 4), np.uint8), lines[:-1]])
    corner = np.pad(up, ((0, 0), (4, 0)))[:, :-4]
    mean = ((left.astype(np.int16) + up) >> 1).astype(np.uint8)
    a, b, c = (x.astype(np.int16) for x in (left, up, corner))
    to_a, to_b, to_c = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
    near = np.where((to_a <= to_b) & (to_a <= to_c), left, np.where(to_b <= to_c, up, corner))
    options = np.stack([lines, lines - left, lines - up, lines - mean, lines - near])
    cost = np.abs(options.view(np.int8).astype(np.int64)).sum(axis=2)
    best = cost.argmin(axis=0)
    rows = np.concatenate([best[:, None].astype(np.uint8), options[best, np.arange(height)]], axis=1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")
