"""AVIF containers: boxes, item properties, items and their tiles; pixels aren't decoded."""

from __future__ import annotations

import struct

from . import CodecError, av1, damaged, need, unsupported


def boxes(data: bytes, at: int = 0, end: int | None = None):
    """(kind, body) one after the other; a size of 1 is followed by 64 bits, 0 reaches to the end."""
    end = len(data) if end is None else end
    while at + 8 <= end:
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        head = 8
        if size == 1:
            (size,) = struct.unpack(">Q", need(data, at + 8, 8))
            head = 16
        size = size or end - at
        if size < head or at + size > end:
            raise damaged("a box is too long")
        yield kind, data[at + head : at + size]
        at += size


def is_avif(data: bytes) -> bool:
    if data[4:8] != b"ftyp" or len(data) < 16:
        return False
    try:
        body = next(b for k, b in boxes(data[: max(16, int.from_bytes(data[:4], "big"))]) if k == b"ftyp")
    except (CodecError, StopIteration):
        return False
    return any(body[i : i + 4] in (b"avif", b"avis") for i in (0, *range(8, len(body) - 3, 4)))


def probe(data: bytes) -> dict:
    """width, height, depths, chroma, colour (primaries, transfer, matrix, full range) of the primary item."""
    parts = _meta(data)
    own = _properties(parts, _primary(parts))
    out = {"width": None, "height": None, "depths": [], "chroma": None, "colour": None}
    for kind, body in own:
        if kind == b"ispe":
            out["width"], out["height"] = struct.unpack(">II", need(body, 4, 8))
        elif kind == b"pixi":
            out["depths"] = list(need(body, 5, need(body, 4, 1)[0]))
        elif kind == b"colr" and body[:4] == b"nclx":
            p, t, m, full = struct.unpack(">HHHB", need(body, 4, 7))
            out["colour"] = {"primaries": p, "transfer": t, "matrix": m, "full_range": bool(full >> 7)}
        elif kind == b"av1C":
            flags = need(body, 2, 1)[0]
            out["depths"] = out["depths"] or [12 if flags & 0x20 else 10 if flags & 0x40 else 8]
            out["chroma"] = "400" if flags & 0x10 else {0: "444", 2: "422", 3: "420"}.get((flags >> 2) & 3, "440")
    if not out["width"]:
        raise damaged("no size")
    return out


def _meta(data: bytes) -> dict[bytes, bytes]:
    if not is_avif(data):
        raise damaged("not an AVIF")
    meta = next((b[4:] for k, b in boxes(data) if k == b"meta"), None)
    if meta is None:
        raise damaged("no meta box")
    return dict(boxes(meta))


def _primary(parts: dict[bytes, bytes]) -> int:
    body = parts.get(b"pitm", b"")
    return int.from_bytes(need(body, 4, 4 if need(body, 0, 1)[0] else 2), "big")


def _properties(parts: dict[bytes, bytes], item: int) -> list[tuple[bytes, bytes]]:
    props = dict(boxes(parts.get(b"iprp", b"")))
    known = list(boxes(props.get(b"ipco", b"")))
    return [known[i - 1] for i in _associations(props.get(b"ipma", b"")).get(item, []) if 0 < i <= len(known)]


def _extents(body: bytes) -> dict[int, tuple[int, list[tuple[int, int]]]]:
    """Item id to construction method and (offset, length) of its parts."""
    version, sizes = need(body, 0, 1)[0], int.from_bytes(need(body, 4, 2), "big")
    if version > 2:
        raise unsupported("unknown item locations")
    offset, length, base, index = (sizes >> k & 15 for k in (12, 8, 4, 0))
    at, out = 6, {}

    def number(size: int) -> int:
        nonlocal at
        at += size
        return int.from_bytes(need(body, at - size, size), "big")

    for _ in range(number(4 if version == 2 else 2)):
        item = number(4 if version == 2 else 2)
        method = number(2) & 15 if version else 0
        number(2)
        first, parts = number(base), []
        for _ in range(number(2)):
            number(index if version else 0)
            start = number(offset)
            parts.append((first + start, number(length)))
        out[item] = (method, parts)
    return out


def item_obus(data: bytes, item: int | None = None) -> bytes:
    """An item's AV1 units (the primary item's by default), its extents joined; a length of 0 reaches to the end."""
    parts = _meta(data)
    method, extents = _extents(parts.get(b"iloc", b"")).get(_primary(parts) if item is None else item, (0, None))
    if extents is None:
        raise damaged("the item has no place")
    if method > 1:
        raise unsupported("items made of other items")
    source = parts.get(b"idat", b"") if method else data
    return b"".join(need(source, start, length or max(0, len(source) - start)) for start, length in extents)


def aux_item(data: bytes, what: str = "alpha") -> int | None:
    """The item that holds the primary item's alpha or depth."""
    parts = _meta(data)
    refs = parts.get(b"iref", b"\0\0\0\0")
    size = 4 if refs[0] else 2
    wanted = {"alpha": (b"auxiliary:alpha", b"auxid:1"), "depth": (b"auxiliary:depth", b"auxid:2")}[what]
    for kind, body in boxes(refs, 4):
        ids = [int.from_bytes(need(body, i, size), "big") for i in (0, *range(size + 2, len(body) - size + 1, size))]
        if kind == b"auxl" and _primary(parts) in ids[1:] and any(k == b"auxC" and b[4:].split(b"\0")[0].endswith(wanted) for k, b in _properties(parts, ids[0])):
            return ids[0]
    return None


def tile_layout(data: bytes) -> list[dict]:
    """Tiles of the primary item's frame, with offsets from the start of the item."""
    parts = _meta(data)
    config = next((b[4:] for k, b in _properties(parts, _primary(parts)) if k == b"av1C"), b"")
    return av1.tiles(item_obus(data), config)[2]


def _associations(body: bytes) -> dict[int, list[int]]:
    if not body:
        return {}
    version, wide = body[0], body[3] & 1
    (count,) = struct.unpack(">I", need(body, 4, 4))
    at, out = 8, {}
    for _ in range(count):
        size = 2 if version < 1 else 4
        item = int.from_bytes(need(body, at, size), "big")
        n = need(body, at + size, 1)[0]
        at += size + 1
        step = 2 if wide else 1
        out[item] = [int.from_bytes(need(body, at + i * step, step), "big") & (0x7FFF if wide else 0x7F) for i in range(n)]
        at += n * step
    return out


def dimensions(data: bytes) -> tuple[int, int]:
    found = probe(data)
    return found["width"], found["height"]


def decode(data: bytes):
    probe(data)
    raise unsupported("AV1 pixels aren't decoded")
