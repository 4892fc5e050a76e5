"""ICO: all entries, bitmaps with masks or PNG; encoder with PNG entries."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from . import CodecError, bmp, check_size, damaged, need, png, to_rgba, unsupported


@dataclass
class Entry:
    pixels: np.ndarray
    bpp: int

    @property
    def area(self) -> int:
        return self.pixels.shape[0] * self.pixels.shape[1]


def is_ico(data: bytes) -> bool:
    return data[:4] == b"\x00\x00\x01\x00"


def directory(data: bytes) -> list[tuple[int, int, int, bytes]]:
    """(width, height, bits, body) of the entries as the directory has them; 0 stands for 256."""
    if data[:4] == b"\x00\x00\x02\x00":
        raise unsupported("cursors aren't supported")
    if not is_ico(data):
        raise damaged("not an ICO")
    (count,) = struct.unpack("<H", need(data, 4, 2))
    if not count:
        raise damaged("no entries")
    out = []
    for i in range(count):
        w, h, _, _, _, bits, size, at = struct.unpack("<BBBBHHII", need(data, 6 + 16 * i, 16))
        out.append((w or 256, h or 256, bits, need(data, at, size)))
    return out


def dimensions(data: bytes) -> tuple[int, int]:
    w, h, _, _ = max(directory(data), key=lambda e: (e[0] * e[1], e[2]))
    return w, h


def _bitmap(body: bytes) -> Entry:
    head = bmp._header(body, 0)
    head["height"] //= 2  # the mask follows the image
    check_size(head["width"], head["height"], 1024)
    if head["packing"] or head["bits"] not in (1, 4, 8, 24, 32):
        raise unsupported("packing or depth isn't supported")
    colors = (head["colors"] or 1 << head["bits"]) if head["bits"] <= 8 else 0
    start = head["size"] + head["entry"] * colors
    pixels = bmp.pixels_of(body, head | {"top_down": False}, head["size"], start)
    h, w = pixels.shape[:2]
    if head["bits"] < 32:
        at = start + (w * head["bits"] + 31) // 32 * 4 * h
        for stride in ((w + 31) // 32 * 4, (w + 7) // 8):  # padded, else packed, else opaque
            if at + stride * h <= len(body):
                mask = np.unpackbits(np.frombuffer(body, np.uint8, stride * h, at).reshape(h, stride), axis=1)[::-1, :w]
                pixels[..., 3] = np.where(mask, 0, 255)
                break
    return Entry(pixels, head["bits"])


def decode_all(data: bytes) -> list[Entry]:
    """Largest first, then most bits, then as in the file."""
    entries = [Entry(png.decode(body), bits or 32) if png.is_png(body) else _bitmap(body) for _, _, bits, body in directory(data)]
    return sorted(entries, key=lambda e: (-e.area, -e.bpp))


def decode(data: bytes) -> np.ndarray:
    return decode_all(data)[0].pixels


def encode_images(images: list[np.ndarray]) -> bytes:
    if not images:
        raise CodecError("invalid_input", "no entries")
    bodies, heads, at = [], [], 6 + 16 * len(images)
    for pixels in images:
        h, w, _ = to_rgba(pixels).shape
        if not 1 <= w <= 256 or not 1 <= h <= 256:
            raise CodecError("invalid_input", "icons have at most 256 pixels a side")
        body = png.encode(pixels)
        heads.append(struct.pack("<BBBBHHII", w & 255, h & 255, 0, 0, 1, 32, len(body), at))
        bodies.append(body)
        at += len(body)
    return b"\x00\x00\x01\x00" + struct.pack("<H", len(images)) + b"".join(heads) + b"".join(bodies)


def encode(pixels: np.ndarray) -> bytes:
    return encode_images([pixels])
