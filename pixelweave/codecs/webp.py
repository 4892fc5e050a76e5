"""WebP containers: stills and the first frame of animations, with lossless or lossy streams and alpha planes. Lossy streams need the
format's tables (``vp8.Tables``). Written are lossless literals."""

from __future__ import annotations

import struct

import numpy as np

from . import CodecError, check_size, damaged, need, to_rgba, unsupported, vp8, vp8l

SIDE = vp8l.SIDE


def is_webp(data: bytes) -> bool:
    return data[:4] == b"RIFF" and data[8:12] == b"WEBP"


def chunks(data: bytes, at: int = 12):
    """(kind, body); sizes are cut at the end of the file."""
    while at + 8 <= len(data):
        kind, size = struct.unpack("<4sI", data[at : at + 8])
        yield kind, data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)


def dimensions(data: bytes) -> tuple[int, int]:
    if not is_webp(data):
        raise damaged("not a WebP")
    for kind, body in chunks(data):
        if kind == b"VP8X":
            return 1 + int.from_bytes(need(body, 4, 3), "little"), 1 + int.from_bytes(need(body, 7, 3), "little")
        if kind == b"VP8L":
            return vp8l.dimensions(body)
        if kind == b"VP8 ":
            if need(body, 3, 3) != b"\x9d\x01\x2a":
                raise damaged("not a key frame")
            w, h = struct.unpack("<HH", need(body, 6, 4))
            return w & 0x3FFF, h & 0x3FFF
    raise damaged("no image")


def decode(data: bytes, tables: vp8.Tables | None = None) -> np.ndarray:
    width, height = dimensions(data)
    check_size(width, height, SIDE)
    wide, alpha = False, None
    for kind, body in chunks(data):
        if kind == b"VP8X":
            wide = True
        elif kind == b"ALPH":
            alpha = body
        elif kind == b"VP8L":
            return _place(vp8l.decode(body), 0, 0, width, height) if wide else vp8l.decode(body)
        elif kind == b"VP8 ":
            return _lossy(body, alpha if wide else None, tables)
        elif kind == b"ANMF" and wide:
            x, y = (2 * int.from_bytes(need(body, at, 3), "little") for at in (0, 3))
            for inner, frame in chunks(body, 16):
                if inner == b"ALPH":
                    alpha = frame
                elif inner == b"VP8L":
                    return _place(vp8l.decode(frame), x, y, width, height)
                elif inner == b"VP8 ":
                    return _place(_lossy(frame, alpha, tables), x, y, width, height)
            raise damaged("a frame without an image")
    raise damaged("no image")


def _lossy(body: bytes, alpha: bytes | None, tables: vp8.Tables | None) -> np.ndarray:
    if tables is None:
        raise unsupported("lossy WebP needs the listings of the format's probabilities")
    check_size(*vp8.dimensions(body), SIDE)
    out = vp8.decode(body, tables)
    if alpha is not None:
        out[..., 3] = alpha_plane(alpha, out.shape[1], out.shape[0])
    return out


def alpha_plane(body: bytes, width: int, height: int) -> np.ndarray:
    """An ALPH chunk's plane: stored as it is or as the green of a lossless stream, each value less the one predicted from its
    neighbours (not at all, the left one, the upper one, or left + upper - upper left)."""
    head = need(body, 0, 1)[0]
    if head & 3 == 0:
        rest = np.frombuffer(need(body, 1, width * height), np.uint8).reshape(height, width).astype(np.int64)
    elif head & 3 == 1:  # a lossless stream without its head
        begin = (0x2F | (width - 1) << 8 | (height - 1) << 22).to_bytes(5, "little")
        rest = vp8l.decode(begin + body[1:])[..., 1].astype(np.int64)
    else:
        raise unsupported("an unknown compression of alpha")
    method = head >> 2 & 3
    if method == 0:
        return rest.astype(np.uint8)
    # the first row goes on from the left, the first column from above
    rest[0] = np.cumsum(rest[0])
    if method == 2:
        rest = np.cumsum(rest, axis=0)
    else:
        rest[:, 0] = np.cumsum(rest[:, 0])
    if method == 1:
        rest[1:] = np.cumsum(rest[1:], axis=1)
    rest &= 255
    if method == 3:
        for d in range(2, width + height - 1):  # a diagonal's values need the ones before
            y = np.arange(max(1, d - width + 1), min(height - 1, d - 1) + 1)
            x = d - y
            rest[y, x] = rest[y, x] + np.clip(rest[y, x - 1] + rest[y - 1, x] - rest[y - 1, x - 1], 0, 255) & 255
    return rest.astype(np.uint8)


def _place(pixels: np.ndarray, x: int, y: int, width: int, height: int) -> np.ndarray:
    """Pixels on a transparent canvas; what lies outside is cut. Fully transparent pixels leave the canvas alone."""
    if pixels.shape[:2] == (height, width) and not x and not y:
        return pixels
    out = np.zeros((height, width, 4), np.uint8)
    part = pixels[: max(0, height - y), : max(0, width - x)]
    out[y : y + part.shape[0], x : x + part.shape[1]] = np.where(part[..., 3:] > 0, part, 0)
    return out


class _Writer:
    def __init__(self) -> None:
        self.out, self.value, self.held = bytearray(), 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.held
        self.held += n
        while self.held >= 8:
            self.out.append(self.value & 255)
            self.value >>= 8
            self.held -= 8

    def done(self) -> bytes:
        return bytes(self.out) + (bytes([self.value & 255]) if self.held else b"")


def encode(pixels: np.ndarray) -> bytes:
    """Literals with 8-bit codes for each channel: lossless, and as plain as the format allows."""
    pixels = to_rgba(pixels)
    height, width, _ = pixels.shape
    if not 1 <= width <= SIDE or not 1 <= height <= SIDE:
        raise CodecError("invalid_input", "too large for WebP")
    bits = _Writer()
    bits.put(0x2F, 8)
    bits.put(width - 1 | (height - 1) << 14 | int((pixels[..., 3] < 255).any()) << 28, 32)
    bits.put(0, 3)  # no transform, cache or meta codes
    for size in (280, 256, 256, 256):
        bits.put(0, 1)
        bits.put(12, 4)  # 16 code lengths' lengths: those of 0 and of 8 are 1 bit
        for s in vp8l.LENGTH_ORDER[:16]:
            bits.put(1 if s in (0, 8) else 0, 3)
        bits.put(0, 1)
        for i in range(size):
            bits.put(int(i < 256), 1)  # 0 codes a length of 0, 1 a length of 8
    bits.put(1, 1)  # distances: one symbol, 0
    bits.put(0, 3)
    flip = np.packbits(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)[:, ::-1], axis=1)[:, 0]
    body = flip[pixels[..., [1, 0, 2, 3]]].tobytes()
    for byte in body:
        bits.put(byte, 8)
    raw = bits.done()
    raw += b"\0" * (len(raw) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(raw)) + b"WEBPVP8L" + struct.pack("<I", len(raw)) + raw
