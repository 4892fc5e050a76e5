"""Lossless WebP streams, written here by hand with every feature."""

import struct

import numpy as np
import pytest

from pixelweave.codecs import CodecError, vp8l, webp


def noise(h, w, seed=0, top=256):
    return np.random.default_rng(seed).integers(0, top, (h, w, 4), dtype=np.uint8)


def reverse8(v):
    return int(f"{v:08b}"[::-1], 2)


class Stream(webp._Writer):
    """Green codes have 9 bits where they hold more than literals, the rest 8."""

    def start(self, h, w):
        self.put(0x2F, 8)
        self.put(w - 1 | (h - 1) << 14 | 1 << 28, 32)
        return self

    def lengths(self, sizes):
        """A code by plain lengths of 0, 8 or 9: codes' codes of 2 bits for 0, 8, 9 and unused 7."""
        self.put(0, 1)
        self.put(15, 4)
        for s in vp8l.LENGTH_ORDER:
            self.put(2 if s in (0, 7, 8, 9) else 0, 3)
        self.put(0, 1)
        for n in sizes:
            self.put({0: 0, 7: 2, 8: 1, 9: 3}[n], 2)

    def codes(self, cache=0, far=None):
        size = 280 + (1 << cache if cache else 0)
        self.plain = not cache and far is None
        if self.plain:
            self.lengths([8] * 256 + [0] * 24)
        else:  # 254 literals of 8 bits, and 4 symbols of 9: literals 254, 255, a copy of 3, one cache slot
            own = [8] * 254 + [9] * 2 + [0] * (size - 256)
            own[258] = own[280 + self.slot if cache else 257] = 9
            self.lengths(own)
            self.nine = [i for i, n in enumerate(own) if n == 9]
        for _ in range(3):
            self.lengths([8] * 256)
        self.put(1, 1)  # distances: one symbol
        self.put(0, 1)
        self.put(1, 1)
        self.put(far or 0, 8)

    def green(self, s):
        if self.plain or s < 254:
            self.put(reverse8(s), 8)
        else:
            self.put(int(f"{508 + self.nine.index(s):09b}"[::-1], 2), 9)

    def pixel(self, p):
        self.green(int(p[1]))
        for c in (p[0], p[2], p[3]):
            self.put(reverse8(int(c)), 8)

    def image(self, pixels, main=False):
        self.put(0, 2 if main else 1)
        self.codes()
        for p in pixels.reshape(-1, 4):
            self.pixel(p)
        return self

    def file(self, extra=b""):
        raw = self.done()
        raw += b"\0" * (len(raw) & 1)
        return raw if extra is None else b"RIFF" + struct.pack("<I", 12 + len(raw)) + b"WEBPVP8L" + struct.pack("<I", len(raw)) + raw


def by_hand(px, y, x, mode):
    """A prediction with plain numbers."""
    h, w, _ = px.shape
    if not y and not x:
        return [0, 0, 0, 255]
    if not y:
        return px[y, x - 1].tolist()
    if not x:
        return px[y - 1, x].tolist()
    at = (px.reshape(-1, 4)[(y - 1) * w + x + 1]).tolist()
    left, top, corner = (px[i].tolist() for i in ((y, x - 1), (y - 1, x), (y - 1, x - 1)))
    out = []
    towards_left = sum(abs(a - b) for a, b in zip(top, corner, strict=True)) < sum(abs(a - b) for a, b in zip(left, corner, strict=True))
    for k, (a, b, c, r) in enumerate(zip(left, top, corner, at, strict=True)):
        m = (a + b) // 2
        half = m + (abs(m - c) // 2) * (1 if m > c else -1)
        out.append([255 * (k == 3), a, b, r, c, ((a + r) // 2 + b) // 2, (a + c) // 2, m, (c + b) // 2, (b + r) // 2, ((a + c) // 2 + (b + r) // 2) // 2, a if towards_left else b, min(255, max(0, a + b - c)), min(255, max(0, half)), 255 * (k == 3), 255 * (k == 3)][mode])
    return out


def test_distance_map():
    assert len(vp8l.NEAR) == 120 and vp8l.NEAR[:8] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2)] and vp8l.NEAR[-1] == (8, 7)
    assert [vp8l.NEAR[i] for i in (34, 35, 36, 39)] == [(0, 5), (3, 4), (-3, 4), (5, 0)]


@pytest.mark.parametrize("mode", range(16))
def test_prediction(mode):
    pixels = noise(9, 11, mode)
    modes = np.zeros((3, 3, 4), np.uint8)
    modes[..., 1] = mode
    rest = np.array([[(pixels[y, x].astype(int) - by_hand(pixels, y, x, mode)) & 255 for x in range(11)] for y in range(9)])
    out = Stream().start(9, 11)
    out.put(1, 1)
    out.put(vp8l.PREDICT, 2)
    out.put(0, 3)  # blocks of 4
    out.image(modes).put(0, 1)
    assert (webp.decode(out.image(rest, main=True).file()) == pixels).all()


def test_mixed_modes_and_green():
    pixels = noise(10, 13, 7)
    modes = noise(3, 4, 8)
    rest = np.array([[(pixels[y, x].astype(int) - by_hand(pixels, y, x, modes[y // 4, x // 4, 1] & 15)) & 255 for x in range(13)] for y in range(10)])
    rest[..., [0, 2]] = (rest[..., [0, 2]] - rest[..., [1]]) & 255
    out = Stream().start(10, 13)
    for kind in (vp8l.PREDICT, vp8l.GREEN):
        out.put(1, 1)
        out.put(kind, 2)
        if kind == vp8l.PREDICT:
            out.put(0, 3)
            out.image(modes)
    out.put(0, 1)
    assert (webp.decode(out.image(rest, main=True).file()) == pixels).all()


def test_colour_transform():
    pixels, factors = noise(9, 10, 1), noise(3, 3, 2)
    rest = pixels.astype(int)

    def signed(v):
        return int(v) - 256 if v > 127 else int(v)

    for y in range(9):
        for x in range(10):
            red_blue, green_blue, green_red = map(signed, factors[y // 4, x // 4, :3])
            r, g, b = map(int, pixels[y, x, :3])
            rest[y, x, 0] = r - (green_red * signed(g) >> 5) & 255
            rest[y, x, 2] = b - (green_blue * signed(g) >> 5) - (red_blue * signed(r) >> 5) & 255
    out = Stream().start(9, 10)
    out.put(1, 1)
    out.put(vp8l.COLOUR, 2)
    out.put(0, 3)
    out.image(factors).put(0, 1)
    assert (webp.decode(out.image(rest, main=True).file()) == pixels).all()


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 16, 17, 256])
def test_palette(size):
    colours = noise(size, 1, size)[:, 0]
    index = np.random.default_rng(size).integers(0, size, (5, 13))
    steps = np.diff(colours.astype(int), axis=0, prepend=0) & 255
    power = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
    packed = np.zeros((5, -(-13 // (1 << power)), 4), int)
    for y in range(5):
        for x in range(13):
            packed[y, x >> power, 1] |= int(index[y, x]) << (x & (1 << power) - 1) * (8 >> power)
    out = Stream().start(5, 13)
    out.put(1, 1)
    out.put(vp8l.PALETTE, 2)
    out.put(size - 1, 8)
    out.image(steps).put(0, 1)
    assert (webp.decode(out.image(packed, main=True).file()) == colours[index]).all()


def test_near_copies():
    pixels = noise(4, 5, 3)
    pixels[1, :3] = pixels[0, :3]
    out = Stream().start(4, 5)
    out.put(0, 1)
    out.put(0, 2)
    out.codes(far=0)  # the pixel above
    flat, at = pixels.reshape(-1, 4), 0
    while at < 20:
        if at == 5:
            out.green(258)
            at += 3
        else:
            out.pixel(flat[at])
            at += 1
    assert (webp.decode(out.file()) == pixels).all()


def test_colour_cache():
    pixels = noise(3, 6, 4)
    pixels[2, 3] = pixels[2, 2]
    r, g, b, a = map(int, pixels[2, 2])
    out = Stream().start(3, 6)
    out.slot = (0x1E35A7BD * (a << 24 | r << 16 | g << 8 | b) & 0xFFFFFFFF) >> 32 - 5
    out.put(0, 1)
    out.put(1, 1)
    out.put(5, 4)
    out.put(0, 1)
    out.codes(cache=5)
    for i, p in enumerate(pixels.reshape(-1, 4)):
        out.green(280 + out.slot) if i == 15 else out.pixel(p)
    assert (webp.decode(out.file()) == pixels).all()


def test_code_groups():
    pixels = noise(8, 8, 5)
    groups = np.zeros((2, 2, 4), np.uint8)
    groups[..., 1] = [[0, 1], [1, 0]]
    out = Stream().start(8, 8)
    out.put(0, 2)
    out.put(1, 1)
    out.put(0, 3)
    out.image(groups)
    out.codes()
    out.codes(far=0)
    for y in range(8):
        for x in range(8):
            out.plain = not groups[y // 4, x // 4, 1]
            out.pixel(pixels[y, x])
    assert (webp.decode(out.file()) == pixels).all()


def chunk(kind, body):
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def extended(flags, width, height, *parts):
    head = chunk(b"VP8X", bytes([flags, 0, 0, 0]) + (width - 1).to_bytes(3, "little") + (height - 1).to_bytes(3, "little"))
    body = b"WEBP" + head + b"".join(parts)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_first_frame_and_canvas():
    pixels = noise(4, 6, 9)
    pixels[0, 0, 3], pixels[1, 1, 3] = 0, 255
    still = webp.encode(pixels)[12:]
    frame = b"".join(n.to_bytes(3, "little") for n in (1, 2, 5, 3, 100)) + b"\0" + still
    got = webp.decode(extended(2, 10, 7, chunk(b"ANIM", bytes(6)), chunk(b"ANMF", frame), chunk(b"ANMF", b"junk")))
    want = np.zeros((7, 10, 4), np.uint8)
    want[4:7, 2:8] = np.where(pixels[:3, :, 3:] > 0, pixels[:3], 0)
    assert (got == want).all()
    assert (webp.decode(extended(0, 6, 4, chunk(b"EXIF", b"abc"), still)) == pixels).all()
    assert webp.decode(extended(0, 8, 5, still)).shape == (5, 8, 4)


@pytest.mark.parametrize("cut", [0, 4, 5, 9, 40, 90, 140])
def test_short_streams(cut):
    raw = Stream().start(4, 5)
    raw.put(0, 1)
    whole = raw.image(noise(4, 5), main=True).file(None)
    with pytest.raises(CodecError):
        vp8l.decode(whole[:cut])
