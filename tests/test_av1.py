"""AV1 headers and AVIF items, written here bit by bit."""

import struct

import pytest

from pixelweave.codecs import CodecError, av1, avif
from pixelweave.sources import files


def pack(*fields):
    """(value, bits) pairs to bytes, filled up with zeros."""
    bits = "".join(f"{v:0{n}b}" for v, n in fields if n)
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def unit(kind, body):
    size, out = len(body), b""
    while True:
        out += bytes([size & 127 | (128 if size > 127 else 0)])
        size >>= 7
        if not size:
            return bytes([kind << 3 | 2]) + out + body


def sequence(width, height, mono=0, cdef=1, restoration=1, grain=0):
    colour = [(0, 1), (mono, 1), (0, 1), (1, 1)] + ([] if mono else [(0, 2), (0, 1)])
    return pack((0, 3), (1, 1), (1, 1), (4, 5), (15, 4), (15, 4), (width - 1, 16), (height - 1, 16), (0, 3), (0, 1), (cdef, 1), (restoration, 1), *colour, (grain, 1), (1, 1))


def frame(grid, after=((100, 8), (0, 3), (0, 1), (0, 1), (0, 1), (0, 6), (0, 6), (0, 3), (0, 1), (0, 2), (0, 2), (0, 12), (0, 6), (1, 1), (0, 1))):
    """Reduced still pictures: no screen content, no other size to render at; the default has a quantizer, no segments or deltas."""
    return [(0, 1), (0, 1), (0, 1), *grid, *after]


def uniform(*more):
    return [(1, 1), *more]


def test_bit_reader():
    b = av1.Bits(pack((5, 3), (0b1111111, 7), (0b00101, 5), (6, 3)))
    assert (b.f(3), b.su(7), b.uvlc(), b.f(3)) == (5, -1, 4, 6)
    assert [av1.Bits(pack((v, n))).ns(5) for v, n in ((0, 2), (1, 2), (2, 2), (6, 3), (7, 3))] == [0, 1, 2, 3, 4]
    assert av1.leb128(b"\xe5\x8e\x26", 0) == (624485, 3)
    with pytest.raises(CodecError):
        b.f(8)


def test_one_tile():
    head = pack(*frame(uniform((0, 1))))
    data = unit(2, b"") + unit(1, sequence(96, 64)) + unit(6, head + b"tile bytes")
    s, h, got = av1.tiles(data)
    assert (s.width, s.height, s.depth, av1.chroma(s), s.full_range) == (96, 64, 8, "420", True) and (h.width, h.quantizer, h.lossless) == (96, 100, False)
    (tile,) = got
    assert data[tile["offset"] :][: tile["size"]] == b"tile bytes" and (tile["mi_row_end"], tile["mi_col_end"]) == (16, 24)


@pytest.mark.parametrize("apart", [False, True])
def test_four_tiles(apart):
    """512 x 512 in blocks of 64: 2 x 2 tiles, in one group or two units."""
    grid = uniform((1, 1), (0, 1), (1, 1), (0, 1), (0, 2), (0, 2))
    parts = [b"a", b"bcd", b"ef", b"last one"]
    sized = [bytes([len(p) - 1]) + p for p in parts]
    head = pack(*frame(grid))
    if apart:
        first, second = pack((1, 1), (0, 2), (1, 2)) + sized[0] + parts[1], pack((1, 1), (2, 2), (3, 2)) + sized[2] + parts[3]
        data = unit(1, sequence(512, 512)) + unit(3, head) + unit(4, first) + unit(4, second)
    else:
        data = unit(1, sequence(512, 512)) + unit(6, head + b"\0" + b"".join(sized[:3]) + parts[3])
    _, _, got = av1.tiles(data)
    assert [data[t["offset"] :][: t["size"]] for t in got] == parts
    assert [(t["row"], t["col"], t["mi_row_start"], t["mi_row_end"], t["mi_col_start"], t["mi_col_end"]) for t in got] == [(r, c, 64 * r, 64 * r + 64, 64 * c, 64 * c + 64) for r in (0, 1) for c in (0, 1)]


def test_own_tile_sizes():
    """Columns of 3 and 5 blocks of 64, one row of 8."""
    grid = [(0, 1), (2, 3), (7, 3), (7, 3), (0, 1), (1, 2)]  # 2 of 8; 4 of 5, which is 111; 7 of 8
    data = unit(1, sequence(512, 512)) + unit(6, pack(*frame(grid)) + b"\0" + b"\2\0abc" + b"rest")
    s, h, got = av1.tiles(data)
    assert h.x == [0, 48, 128] and h.y == [0, 128] and h.size_bytes == 2
    assert [data[t["offset"] :][: t["size"]] for t in got] == [b"abc", b"rest"]


def test_lossless_mono_and_segments():
    lossless = ((0, 8), (0, 1), (0, 1), (0, 1), (0, 1))
    s, h, got = av1.tiles(unit(1, sequence(40, 24, mono=1)) + unit(6, pack(*frame(uniform(), lossless)) + b"x"))
    assert av1.chroma(s) == "400" and h.lossless and got[0]["size"] == 1
    segments = [(1, 1), *[(1, 1), (7, 9), (0, 7)], *[(0, 8)] * 7]  # the first one gains 7: not lossless
    rest = ((0, 8), (0, 1), (0, 1), *segments, (0, 6), (0, 6), (0, 3), (0, 1), (0, 2), (0, 2), (0, 6), (0, 2), (1, 1), (0, 1))
    _, h, got = av1.tiles(unit(1, sequence(40, 24, mono=1)) + unit(6, pack(*frame(uniform(), rest)) + b"xyz"))
    assert not h.lossless and h.segments[0] == {0: 7} and got[0]["size"] == 3


def test_film_grain():
    body = frame(uniform((0, 1))) + [(1, 1), (9, 16), (1, 4), (3, 16), (0, 1), (1, 4), (7, 16), (0, 4), (0, 2), (1, 2), (0, 32), (0, 40), (0, 4), (0, 25), (0, 2)]
    data = unit(1, sequence(96, 64, grain=1)) + unit(6, pack(*body) + b"grainy")
    assert data[av1.tiles(data)[2][0]["offset"] :] == b"grainy"


def box(kind, body):
    return struct.pack(">I", len(body) + 8) + kind + body


def container(obus, inside=False):
    config = box(b"av1C", b"\x81\x00\x4c\x00" + unit(1, sequence(96, 64)))
    aux = box(b"auxC", b"\0\0\0\0urn:mpeg:mpegB:cicp:systems:auxiliary:alpha\0")
    props = box(b"ipco", box(b"ispe", struct.pack(">III", 0, 96, 64)) + config + aux)
    links = box(b"ipma", b"\0\0\0\0" + struct.pack(">I", 2) + struct.pack(">HB", 1, 2) + b"\1\2" + struct.pack(">HB", 2, 2) + b"\1\3")

    def build(start):
        loc = b"\1\0\0\0" + b"\x44\x00" + struct.pack(">H", 1) + struct.pack(">HHHH", 1, int(inside), 0, 2) + struct.pack(">IIII", start, 5, start + 5, len(obus) - 5)
        refs = box(b"iref", b"\0\0\0\0" + box(b"auxl", struct.pack(">HHH", 2, 1, 1)))
        meta = b"\0\0\0\0" + box(b"pitm", b"\0\0\0\0\0\1") + box(b"iloc", loc) + box(b"iprp", props + links) + refs
        return box(b"ftyp", b"avif\0\0\0\0avif") + box(b"meta", meta + (box(b"idat", obus) if inside else b""))

    return build(0) if inside else build(len(build(0)) + 8) + box(b"mdat", obus)


@pytest.mark.parametrize("inside", [False, True])
def test_items(inside):
    obus = unit(6, pack(*frame(uniform((0, 1)))) + b"tile bytes")
    data = container(obus, inside)
    assert avif.item_obus(data) == obus and avif.aux_item(data) == 2 and avif.aux_item(data, "depth") is None
    (tile,) = avif.tile_layout(data)
    assert obus[tile["offset"] :][: tile["size"]] == b"tile bytes"
    with pytest.raises(CodecError):
        avif.item_obus(data, 9)


def test_tiles_as_rows(spark):
    obus = unit(6, pack(*frame(uniform((0, 1)))) + b"tile bytes")
    rows = [("a.avif", container(obus)), ("b.avif", container(obus[:9])), ("c.avif", b""), ("d.avif", None)]
    got = {r.path: r for r in files.av1_tiles(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert (got["a.avif"].num, got["a.avif"].size, got["a.avif"].mi_col_end, got["a.avif"].error) == (0, 10, 24, None)
    assert all(got[k].error.kind == "decode" and got[k].size is None for k in ("b.avif", "c.avif", "d.avif"))


@pytest.mark.parametrize("data", [b"", b"\x80", unit(6, b"abc"), unit(1, b"\x18"), b"\x0a\xff"])
def test_damaged_streams(data):
    with pytest.raises(CodecError):
        av1.tiles(data)
