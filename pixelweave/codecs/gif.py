"""GIF: the first frame on a transparent canvas; encoder with an exact palette or median cut."""

from __future__ import annotations

import struct

import numpy as np

from . import CodecError, check_size, damaged, need, to_rgba


def is_gif(data: bytes) -> bool:
    return data[:6] in (b"GIF87a", b"GIF89a")


def dimensions(data: bytes) -> tuple[int, int]:
    if not is_gif(data):
        raise damaged("not a GIF")
    return struct.unpack("<HH", need(data, 6, 4))


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while (n := need(data, at, 1)[0]):
        parts.append(need(data, at + 1, n))
        at += n + 1
    return b"".join(parts), at + 1


def decode(data: bytes) -> np.ndarray:
    width, height = dimensions(data)
    check_size(width, height, 65_535)
    flags = need(data, 10, 1)[0]
    at, colors, clear = 13, None, -1
    if flags & 128:
        colors = np.frombuffer(need(data, at, 3 * (2 << (flags & 7))), np.uint8).reshape(-1, 3)
        at += colors.size
    while True:
        kind = need(data, at, 1)[0]
        if kind == 0x21:
            label = need(data, at + 1, 1)[0]
            body, at = _blocks(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                clear = body[3] if body[0] & 1 else -1
        elif kind == 0x2C:
            x, y, w, h, local = struct.unpack("<HHHHB", need(data, at + 1, 9))
            at += 10
            if local & 128:
                colors = np.frombuffer(need(data, at, 3 * (2 << (local & 7))), np.uint8).reshape(-1, 3)
                at += colors.size
            if colors is None:
                raise damaged("the palette is missing")
            check_size(w, h, 65_535)
            code_bits = need(data, at, 1)[0]
            body, _ = _blocks(data, at + 1)
            index = np.frombuffer(_expand(body, code_bits, w * h), np.uint8).reshape(h, w)
            if local & 64:
                order = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
                straight = np.empty_like(index)
                straight[order] = index
                index = straight
            return _place(index, colors, clear, x, y, width, height)
        else:
            raise damaged("no image")


def _place(index, colors, clear, x, y, width, height) -> np.ndarray:
    out = np.zeros((height, width, 4), np.uint8)
    index = index[: max(0, height - y), : max(0, width - x)]
    if index.size:
        if int(index.max()) >= len(colors):
            raise damaged("a pixel is beyond the palette")
        part = out[y : y + index.shape[0], x : x + index.shape[1]]
        part[..., :3] = colors[index]
        part[..., 3] = np.where(index == clear, 0, 255)
    return out


def _expand(body: bytes, first_bits: int, size: int) -> bytes:
    """LZW; the table stops growing at 4096 codes."""
    if not 2 <= first_bits <= 11:
        raise damaged("wrong code size")
    clear, end = 1 << first_bits, (1 << first_bits) + 1
    start = [bytes([i & 255]) for i in range(clear)] + [b"", b""]
    table, bits, out, last = list(start), first_bits + 1, bytearray(), None
    buffer = held = 0
    for byte in body:
        buffer |= byte << held
        held += 8
        while held >= bits:
            code = buffer & ((1 << bits) - 1)
            buffer >>= bits
            held -= bits
            if code == clear:
                table, bits, last = list(start), first_bits + 1, None
                continue
            if code == end:
                return _filled(out, size)
            if last is None:
                if code >= clear:
                    raise damaged("wrong first code")
                word = table[code]
            else:
                if code < len(table):
                    word = table[code]
                elif code == len(table) and len(table) < 4096:
                    word = last + last[:1]
                else:
                    raise damaged("wrong code")
                if len(table) < 4096:
                    table.append(last + word[:1])
                    if len(table) == 1 << bits and bits < 12:
                        bits += 1
            out += word
            last = word
            if len(out) >= size:
                return _filled(out, size)
    return _filled(out, size)


def _filled(out: bytearray, size: int) -> bytes:
    if len(out) < size:
        raise damaged("the pixel data ends early")
    return bytes(out[:size])


def _shrink(index: bytes, first_bits: int) -> bytes:
    clear, end = 1 << first_bits, (1 << first_bits) + 1
    out, buffer, held, bits = bytearray(), 0, 0, first_bits + 1

    def put(code: int) -> None:
        nonlocal buffer, held
        buffer |= code << held
        held += bits
        while held >= 8:
            out.append(buffer & 255)
            buffer >>= 8
            held -= 8

    put(clear)
    table: dict[tuple[int, int], int] = {}
    free, word = end + 1, index[0]
    for v in index[1:]:
        known = table.get((word, v))
        if known is not None:
            word = known
            continue
        put(word)
        if free < 4096:
            table[word, v] = free
            if free == 1 << bits and bits < 12:
                bits += 1
            free += 1
        else:
            put(clear)
            table, free, bits = {}, end + 1, first_bits + 1
        word = v
    put(word)
    put(end)
    if held:
        out.append(buffer & 255)
    return bytes(out)


def _cut(colors: np.ndarray, counts: np.ndarray, most: int) -> list[np.ndarray]:
    """Boxes of colours: the one with the widest channel is cut at its weighted median."""
    boxes = [np.arange(len(colors))]
    while len(boxes) < most:
        spans = [np.ptp(colors[b], axis=0) if len(b) > 1 else np.zeros(3, int) for b in boxes]
        i = max(range(len(boxes)), key=lambda j: int(spans[j].max()))
        if not spans[i].max():
            break
        axis = int(spans[i].argmax())
        box = boxes[i][np.argsort(colors[boxes[i], axis], kind="stable")]
        total = np.cumsum(counts[box])
        cut = min(len(box) - 1, max(1, int(np.searchsorted(total, total[-1] / 2)) + 1))
        boxes[i : i + 1] = [box[:cut], box[cut:]]
    return boxes


def quantize(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Palette, index per pixel, and the transparent index or -1. Alpha below 128 is transparent."""
    visible = pixels[..., 3] >= 128
    clear = not visible.all()
    most = 255 if clear else 256
    colors, inverse, counts = np.unique(pixels[visible][:, :3].astype(np.int64), axis=0, return_inverse=True, return_counts=True)
    if len(colors) > most:
        boxes = _cut(colors, counts, most)
        palette = np.array([np.round(np.average(colors[b], axis=0, weights=counts[b])) for b in boxes], np.int64)
        near = np.concatenate([((part[:, None, :] - palette[None]) ** 2).sum(axis=2).argmin(axis=1) for part in np.array_split(colors, -(-len(colors) // 4096))])
        own = near[inverse.ravel()]
    else:
        palette, own = colors.reshape(-1, 3), inverse.ravel()
    index = np.full(visible.shape, len(palette), np.int64)
    index[visible] = own
    if clear:
        palette = np.vstack([palette, np.zeros((1, 3), np.int64)])
    return palette.astype(np.uint8), index.astype(np.uint8), len(palette) - 1 if clear else -1


def encode(pixels: np.ndarray) -> bytes:
    pixels = to_rgba(pixels)
    height, width, _ = pixels.shape
    if width > 65_535 or height > 65_535:
        raise CodecError("invalid_input", "too large for GIF")
    palette, index, clear = quantize(pixels)
    bits = max(1, int(len(palette) - 1).bit_length())
    table = np.zeros((1 << bits, 3), np.uint8)
    table[: len(palette)] = palette
    out = b"GIF89a" + struct.pack("<HHBBB", width, height, 0xF0 | (bits - 1), 0, 0) + table.tobytes()
    if clear >= 0:
        out += b"\x21\xf9\x04\x01\x00\x00" + bytes([clear]) + b"\x00"
    body = _shrink(index.tobytes(), max(2, bits))
    parts = b"".join(bytes([len(p)]) + p for p in (body[i : i + 255] for i in range(0, len(body), 255)))
    return out + b"\x2c" + struct.pack("<HHHHB", 0, 0, width, height, 0) + bytes([max(2, bits)]) + parts + b"\x00\x3b"
