"""A hand-made font and its texts, and fonts of the system where there are any."""

import struct

import numpy as np
import pytest

from pixelweave.functions import fonts
from pixelweave.operators import compose
from pixelweave.sources import derived


def made(family="Blocks", style="Regular"):
    """A: a square of 500 units; B: a triangle with a curve; C: A moved and halved; ascent 800, descent -200."""
    corner = lambda points: struct.pack(">hhhhh", 1, *[0] * 4) + struct.pack(">HH", len(points) - 1, 0) + bytes(p[2] for p in points) + b"".join(struct.pack(">h", p[0]) for p in points) + b"".join(struct.pack(">h", p[1]) for p in points)
    square = corner([(0, 0, 1), (500, 0, 1), (0, 500, 1), (-500, 0, 1)])
    curve = corner([(0, 0, 1), (400, 0, 1), (0, 400, 0), (-400, 0, 1)])
    part = struct.pack(">hhhhh", -1, *[0] * 4) + struct.pack(">HHbbh", 2 | 8, 1, 100, 50, 8192)
    glyphs = [b"", square, curve, part]
    glyphs = [g + b"\0" * (-len(g) % 4) for g in glyphs]
    offsets = np.cumsum([0, *map(len, glyphs)]).tolist()
    cmap = struct.pack(">HHHHI", 0, 1, 3, 1, 12) + struct.pack(">HHHHHHH", 4, 32, 0, 4, 0, 0, 0) + struct.pack(">HH", ord("C"), 0xFFFF) + b"\0\0" + struct.pack(">HH", ord("A"), 0xFFFF) + struct.pack(">HH", (1 - ord("A")) & 0xFFFF, 1) + struct.pack(">HH", 0, 0)
    texts = [(1, family), (2, style), (4, f"{family} {style}")]
    raw = [t.encode("utf-16-be") for _, t in texts]
    names = struct.pack(">HHH", 0, 3, 6 + 36) + b"".join(struct.pack(">6H", 3, 1, 0x409, k, len(r), sum(map(len, raw[:i]))) for i, ((k, _), r) in enumerate(zip(texts, raw, strict=True))) + b"".join(raw)
    tables = {
        b"cmap": cmap, b"glyf": b"".join(glyphs), b"head": bytes(50) + struct.pack(">hh", 1, 0), b"hhea": struct.pack(">Ihh", 0, 800, -200) + bytes(26) + struct.pack(">H", 2),
        b"hmtx": struct.pack(">HhHhhh", 300, 0, 600, 0, 0, 0), b"loca": struct.pack(">5I", *offsets), b"maxp": struct.pack(">IH", 0, 4), b"name": names,
    }
    out, at = b"\0\1\0\0" + struct.pack(">HHHH", len(tables), 0, 0, 0), 12 + 16 * len(tables)
    for name, body in tables.items():
        out += name + struct.pack(">III", 0, at, len(body))
        at += len(body)
    return out + b"".join(tables.values())


def test_outlines():
    font = fonts.Font(made())
    assert [font.places.get(ord(c)) for c in "ABCD"] == [1, 2, 3, None] and [font.width(g) for g in range(4)] == [300, 600, 600, 600]
    assert font.contours(1)[0].tolist() == [[0, 0], [500, 0], [500, 500], [0, 500], [0, 0]]
    assert font.contours(3)[0].tolist() == [[100, 50], [350, 50], [350, 300], [100, 300], [100, 50]]
    assert font.contours(0) == [] and len(font.contours(2)[0]) == 1 + 1 + fonts.PIECES + 1
    x, y = font.contours(2)[0].T
    area = abs(np.dot(x[:-1], y[1:]) - np.dot(x[1:], y[:-1])) / 2
    assert area == pytest.approx(400 * 400 * 2 / 3 - 0, rel=0.26)
    for bad in (b"", b"OTTO" + bytes(40), made()[:200]):
        with pytest.raises(ValueError):
            fonts.Font(bad)


def test_coverage():
    square = np.array([[0.25, 0.5], [2.5, 0.5], [2.5, 2], [0.25, 2], [0.25, 0.5]])
    left, top, share = fonts.coverage([square])
    assert (left, top) == (0, 0) and share.tolist() == [[0.375, 0.5, 0.25], [0.75, 1, 0.5]]
    hole = np.array([[1, 1], [1, 1.5], [2, 1.5], [2, 1], [1, 1.0]])
    assert fonts.coverage([square, hole])[2].sum() == pytest.approx(share.sum() - 0.5)
    triangle = np.array([[0, 0], [8, 0], [0, 6], [0, 0.0]])
    assert fonts.coverage([triangle])[2].sum() == pytest.approx(24, abs=0.1)


def test_text(spark, tmp_path):
    (tmp_path / "z.ttf").write_bytes(made())
    (tmp_path / "a.ttf").write_bytes(made(style="Bold"))
    (tmp_path / "broken.ttf").write_bytes(b"nothing")
    image = derived.fixed_dims(derived.solid(spark, 40, 30, (10, 20, 30, 100)), 40, 30)
    folders = [str(tmp_path)]
    got = {(r.x, r.y): (r.r, r.g, r.b, r.a) for r in compose.watermark_text(image, "AAD", 3, 5, 20.0, (210, 120, 30, 128), "blocks", folders).collect()}
    # 20 pixels high: 0.02 a unit; the square is 10 pixels, its foot at 5 + 16; the next one is 12 further on; D isn't there
    inside = {(x, y) for x in [*range(3, 13), *range(15, 25)] for y in range(11, 21)}
    share = np.float32(128) / np.float32(255)
    mixed = tuple(int(np.floor(np.float32(o) * (1 - share) + np.float32(n) * share + 0.5)) for o, n in zip((10, 20, 30), (210, 120, 30), strict=True))
    under = np.float32(100) / np.float32(255)
    alpha = int(np.floor((under + share * (1 - under)) * 255 + 0.5))
    assert len(got) == 1200 and {k for k, v in got.items() if v != (10, 20, 30, 100)} == inside
    assert {got[k] for k in inside} == {(*mixed, alpha)}
    assert fonts.find("Blocks Bold", folders) is not None and fonts.find("Other", folders) is None
    bar = compose.watermark_bar(image, "AB", 3, 5, 20.0, (210, 120, 30, 128))
    assert sorted(compose.watermark_text(image, "AB", 3, 5, 20.0, (210, 120, 30, 128), "Other", folders).collect()) == sorted(bar.collect())
    with pytest.raises(ValueError):
        compose.watermark_text(image, "", 0, 0, 9.0, (0, 0, 0, 0))


def test_overlapping_glyphs_are_blended_in_turn(spark, tmp_path):
    font = fonts.Font(made())
    font.width = lambda g: 100
    rows = fonts.text_coverage(font, "AA", 0, 0, 10.0)
    seen = [(x, y) for _, x, y, _ in rows]
    assert len(seen) > len(set(seen)) and [n for n, *_ in rows] == sorted(n for n, *_ in rows)


def test_system_fonts():
    if (font := fonts.find("DejaVu Sans")) is None:
        pytest.skip("needs a font")
    rows = fonts.text_coverage(font, "Agé", 0, 0, 48.0)
    assert {n for n, *_ in rows} == {0, 1, 2} and all(0 < s <= 1 for *_, s in rows) and max(y for _, _, y, _ in rows) < 49
    ink = [sum(s for n, _, _, s in rows if n == k) for k in range(3)]
    assert all(60 < x < 600 for x in ink)
