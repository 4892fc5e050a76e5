"""BMP: 1 to 32 bits, RLE4 and RLE8, bit fields; encoder for 32 bits with alpha. Also the images inside icons."""

from __future__ import annotations

import struct

import numpy as np

from . import check_size, damaged, need, to_rgba, unsupported

SIDE = 32_768


def is_bmp(data: bytes) -> bool:
    return data[:2] == b"BM"


def dimensions(data: bytes) -> tuple[int, int]:
    if not is_bmp(data):
        raise damaged("not a BMP")
    head = _header(data, 14)
    return head["width"], head["height"]


def _header(data: bytes, at: int) -> dict:
    (size,) = struct.unpack("<I", need(data, at, 4))
    if size == 12:
        w, h, _, bits = struct.unpack("<HHHH", need(data, at + 4, 8))
        return {"size": 12, "width": w, "height": h, "top_down": False, "bits": bits, "packing": 0, "colors": 0, "entry": 3, "masks": None}
    if size < 40:
        raise damaged("unknown header")
    w, h, _, bits, packing, _, _, _, colors = struct.unpack("<iiHHIIiiI", need(data, at + 4, 32))
    masks = None
    if packing in (3, 6):
        masks = struct.unpack("<III", need(data, at + 40, 12))
    return {"size": size, "width": w, "height": abs(h), "top_down": h < 0, "bits": bits, "packing": packing, "colors": colors, "entry": 4, "masks": masks}


def decode(data: bytes) -> np.ndarray:
    if not is_bmp(data):
        raise damaged("not a BMP")
    head = _header(data, 14)
    check_size(head["width"], head["height"], SIDE)
    (start,) = struct.unpack("<I", need(data, 10, 4))
    table = 14 + head["size"] + (12 if head["masks"] and head["size"] == 40 else 0)
    return pixels_of(data, head, table, start)


def palette_of(data: bytes, head: dict, at: int) -> np.ndarray:
    count = min(head["colors"] or 1 << head["bits"], 256)
    count = min(count, max(0, (len(data) - at) // head["entry"]))
    raw = np.frombuffer(data, np.uint8, count * head["entry"], at).reshape(count, head["entry"])
    return raw[:, 2::-1]


def pixels_of(data: bytes, head: dict, table: int, start: int) -> np.ndarray:
    """Decodes the pixels; table: where the palette starts, start: where the pixels do."""
    width, height, bits, packing = (head[k] for k in ("width", "height", "bits", "packing"))
    out = np.full((height, width, 4), 255, np.uint8)
    if packing in (1, 2):
        if (packing, bits) not in ((1, 8), (2, 4)):
            raise damaged("packing and depth don't agree")
        index = _run_lengths(need(data, start, len(data) - start), width, height, bits)
    elif packing in (0, 3, 6) and bits in (1, 4, 8, 16, 24, 32):
        stride = (width * bits + 31) // 32 * 4
        rows = np.frombuffer(need(data, start, stride * height), np.uint8).reshape(height, stride)
        if bits <= 8:
            if packing:
                raise damaged("packing and depth don't agree")
            cells = np.unpackbits(rows, axis=1).reshape(height, -1, bits)
            index = (cells * (1 << np.arange(bits - 1, -1, -1))).sum(axis=2)[:, :width]
        else:
            _true_color(out, rows, width, bits, head["masks"])
            return out if head["top_down"] else out[::-1].copy()
    else:
        raise unsupported("packing or depth isn't supported")
    palette = palette_of(data, head, table)
    if index.size and int(index.max()) >= len(palette):
        raise damaged("a pixel is beyond the palette")
    out[..., :3] = palette[index]
    return out if head["top_down"] else out[::-1].copy()


def _true_color(out: np.ndarray, rows: np.ndarray, width: int, bits: int, masks) -> None:
    if bits == 24:
        out[..., :3] = rows[:, : width * 3].reshape(-1, width, 3)[..., ::-1]
    elif bits == 32 and not masks:
        cells = rows.reshape(-1, width, 4)
        out[..., :3], out[..., 3] = cells[..., 2::-1], cells[..., 3]
    else:
        cells = rows[:, : width * bits // 8].copy().view(f"<u{bits // 8}").astype(np.uint64)
        for c, mask in enumerate(masks or (0x7C00, 0x3E0, 0x1F)):
            if not mask:
                out[..., c] = 0
                continue
            shift = (mask & -mask).bit_length() - 1
            top = mask >> shift
            out[..., c] = (((cells & np.uint64(mask)) >> np.uint64(shift)) * np.uint64(255) + np.uint64(top // 2)) // np.uint64(top)


def _run_lengths(data: bytes, width: int, height: int, bits: int) -> np.ndarray:
    out = np.zeros((height, width), np.int64)
    x = y = at = 0

    def put(values) -> None:
        nonlocal x
        if y >= height or x + len(values) > width:
            raise damaged("a run leaves the image")
        out[y, x : x + len(values)] = values
        x += len(values)

    while at + 1 < len(data):
        n, v = data[at], data[at + 1]
        at += 2
        if n:
            pair = (v, v) if bits == 8 else (v >> 4, v & 15)
            put([pair[i & 1] for i in range(n)])
        elif v == 0:
            x, y = 0, y + 1
        elif v == 1:
            return out
        elif v == 2:
            move = need(data, at, 2)
            x, y, at = x + move[0], y + move[1], at + 2
        else:
            size = v if bits == 8 else (v + 1) // 2
            raw = need(data, at, size)
            put(list(raw) if bits == 8 else [(b >> s) & 15 for b in raw for s in (4, 0)][:v])
            at += size + (size & 1)
    return out


def encode(pixels: np.ndarray) -> bytes:
    pixels = to_rgba(pixels)
    height, width, _ = pixels.shape
    body = pixels[::-1, :, [2, 1, 0, 3]].tobytes()
    head = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 32, 0, len(body), 2835, 2835, 0, 0)
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + head + body
