"""Lossless WebP streams: prefix codes, copies, colour caches, prefix code groups and the four transforms."""

from __future__ import annotations

import numpy as np

from . import check_size, damaged, need, unsupported

SIDE, GROUPS = 16_384, 4096
# The order of the code-length code's lengths.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Distance codes 1 to 120: pixels to the left and above, nearest first, then by column, left before right.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if x > 0 or (y and x > -8)), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))
PREDICT, COLOUR, GREEN, PALETTE = range(4)


class _Bits:
    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.value, self.held = data, 0, 0, 0

    def fill(self, n: int) -> None:
        """Hold n bits, or all that are left."""
        while self.held < n and self.at < len(self.data):
            part = self.data[self.at : self.at + 8]
            self.value |= int.from_bytes(part, "little") << self.held
            self.at += len(part)
            self.held += 8 * len(part)

    def drop(self, n: int) -> None:
        if n > self.held:
            raise damaged("the stream ends early")
        self.value >>= n
        self.held -= n

    def read(self, n: int) -> int:
        self.fill(n)
        out = self.value & ((1 << n) - 1)
        self.drop(n)
        return out


class _Code:
    """A canonical prefix code: codes of up to 8 bits by a table, longer ones bit by bit."""

    def __init__(self, lengths: list[int]) -> None:
        used = sorted((n, s) for s, n in enumerate(lengths) if n)
        self.single = used[0][1] if len(used) == 1 else None
        if not used or (self.single is None and sum(1 << 15 - n for n, _ in used) != 1 << 15):
            raise damaged("wrong prefix code")
        self.short: list[tuple[int, int] | None] = [None] * 256
        self.long: dict[tuple[int, int], int] = {}
        self.most = used[-1][0]
        code = last = 0
        for n, s in used:
            code <<= n - last
            last = n
            if n <= 8:
                first = int(f"{code:0{n}b}"[::-1], 2)  # the first bit of a code is the lowest one read
                self.short[first :: 1 << n] = [(n, s)] * (256 >> n)
            else:
                self.long[n, code] = s
            code += 1

    def read(self, bits: _Bits) -> int:
        if self.single is not None:
            return self.single
        if bits.held < 15:
            bits.fill(15)
        if found := self.short[bits.value & 255]:
            bits.drop(found[0])
            return found[1]
        code = 0
        for n in range(1, self.most + 1):
            code = code << 1 | (bits.value >> (n - 1) & 1)
            if n > 8 and (s := self.long.get((n, code))) is not None:
                bits.drop(n)
                return s
        raise damaged("the stream ends early")


def _read_code(bits: _Bits, size: int) -> _Code:
    lengths = [0] * size
    if bits.read(1):
        two = bits.read(1)
        symbols = [bits.read(8 if bits.read(1) else 1)]
        if two:
            symbols.append(bits.read(8))
        for s in symbols:
            if s >= size:
                raise damaged("wrong symbol")
            lengths[s] = 1
        return _Code(lengths)
    inner = [0] * 19
    for i in range(4 + bits.read(4)):
        inner[LENGTH_ORDER[i]] = bits.read(3)
    code = _Code(inner)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    at, before = 0, 8
    while at < size and left:
        left -= 1
        s = code.read(bits)
        if s < 16:
            lengths[at] = s
            at += 1
            before = s or before
        else:
            n, value = (3 + bits.read(2), before) if s == 16 else (3 + bits.read(3), 0) if s == 17 else (11 + bits.read(7), 0)
            if at + n > size:
                raise damaged("too many lengths")
            lengths[at : at + n] = [value] * n
            at += n
    return _Code(lengths)


def _extra(bits: _Bits, s: int) -> int:
    if s < 4:
        return s + 1
    n = (s - 2) >> 1
    return ((2 + (s & 1)) << n) + bits.read(n) + 1


def _blocks(side: int, power: int) -> int:
    return -(-side >> power)


def _image(bits: _Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image, as an array of RGBA."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise damaged("wrong colour cache")
    groups, power, count = None, 0, 1
    if main and bits.read(1):
        power = bits.read(3) + 2
        map_ = _image(bits, _blocks(width, power), _blocks(height, power), False).astype(np.int64)
        groups = (map_[..., 0] << 8 | map_[..., 1]).tolist()
        count = 1 + max(map(max, groups))
        if count > GROUPS:
            raise unsupported(f"over {GROUPS} groups of prefix codes")
    sizes = (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [[_read_code(bits, n) for n in sizes] for _ in range(count)]
    cache, shift = [0] * (1 << cache_bits), 32 - cache_bits
    n = width * height
    out = [0] * n  # pixels as ARGB numbers
    at = 0
    green, red, blue, alpha, far = codes[0]
    while at < n:
        if groups is not None:
            y, x = divmod(at, width)
            green, red, blue, alpha, far = codes[groups[y >> power][x >> power]]
        s = green.read(bits)
        if s >= 256 + 24:
            value, length = cache[s - 280], 1
        elif s < 256:
            value, length = red.read(bits) << 16 | s << 8 | blue.read(bits) | alpha.read(bits) << 24, 1
        else:
            length, d = _extra(bits, s - 256), _extra(bits, far.read(bits))
            if d <= 120:
                x, y = NEAR[d - 1]
                d = max(1, x + y * width)
            else:
                d -= 120
            if d > at or at + length > n:
                raise damaged("a copy leaves the image")
            for i in range(at, at + length):
                out[i] = value = out[i - d]
                if cache_bits:
                    cache[(0x1E35A7BD * value & 0xFFFFFFFF) >> shift] = value
            at += length
            continue
        out[at] = value
        at += 1
        if cache_bits:
            cache[(0x1E35A7BD * value & 0xFFFFFFFF) >> shift] = value
    argb = np.array(out, np.uint32).reshape(height, width)
    return np.stack([argb >> 16 & 255, argb >> 8 & 255, argb & 255, argb >> 24], axis=2).astype(np.uint8)


def dimensions(body: bytes) -> tuple[int, int]:
    if need(body, 0, 1) != b"\x2f":
        raise damaged("wrong lossless signature")
    bits = int.from_bytes(need(body, 1, 4), "little")
    if bits >> 29:
        raise unsupported("unknown lossless version")
    return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1


def decode(body: bytes) -> np.ndarray:
    width, height = dimensions(body)
    check_size(width, height, SIDE)
    bits = _Bits(body[5:])
    steps: list[tuple] = []
    wide = width
    while bits.read(1):
        kind = bits.read(2)
        if kind in [k for k, *_ in steps]:
            raise damaged("a transform comes twice")
        if kind in (PREDICT, COLOUR):
            power = bits.read(3) + 2
            steps.append((kind, wide, power, _image(bits, _blocks(wide, power), _blocks(height, power), False)))
        elif kind == GREEN:
            steps.append((kind, wide, 0, None))
        else:
            size = bits.read(8) + 1
            colours = np.cumsum(_image(bits, size, 1, False)[0], axis=0, dtype=np.uint8)
            power = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            steps.append((kind, wide, power, colours))
            wide = _blocks(wide, power)
    out = _image(bits, wide, height, True)
    for kind, wide, power, data in reversed(steps):
        if kind == PREDICT:
            _add_prediction(out, power, data)
        elif kind == COLOUR:
            _add_colour(out, power, data)
        elif kind == GREEN:
            out[..., 0] += out[..., 1]
            out[..., 2] += out[..., 1]
        else:
            out = _look_up(out, wide, power, data)
    return out


def _look_up(packed: np.ndarray, width: int, power: int, colours: np.ndarray) -> np.ndarray:
    """Green holds one index, or several of 8 >> power bits, lowest first."""
    depth = 8 >> power
    x = np.arange(width)
    index = packed[:, x >> power, 1] >> ((x & (1 << power) - 1) * depth).astype(np.uint8) & (1 << depth) - 1
    table = np.zeros((256, 4), np.uint8)
    table[: len(colours)] = colours
    return table[index]


def _add_colour(out: np.ndarray, power: int, factors: np.ndarray) -> None:
    """Red gains from green, then blue from green and from the new red; factors are in 1/32."""
    height, width, _ = out.shape
    each = np.repeat(np.repeat(factors, 1 << power, axis=0)[:height], 1 << power, axis=1)[:, :width].astype(np.int8).astype(np.int32)

    def gain(factor, channel):
        return ((factor * channel.astype(np.int8)) >> 5).astype(np.uint8)

    out[..., 0] += gain(each[..., 2], out[..., 1])
    out[..., 2] += gain(each[..., 1], out[..., 1]) + gain(each[..., 0], out[..., 0])


def _mean(a, b):
    return (a + b) >> 1


def _nearer(left, top, corner):
    """The neighbour that the gradient left + top - corner is nearer to, over all channels; the top one in a tie."""
    return left if np.abs(top - corner).sum() < np.abs(left - corner).sum() else top


#: Predictions by mode from arrays of left, top, top left and top right; modes 0 and over 13 are opaque black.
MODES = {
    1: lambda l, t, c, r: l, 2: lambda l, t, c, r: t, 3: lambda l, t, c, r: r, 4: lambda l, t, c, r: c,
    5: lambda l, t, c, r: _mean(_mean(l, r), t), 6: lambda l, t, c, r: _mean(l, c), 7: lambda l, t, c, r: _mean(l, t),
    8: lambda l, t, c, r: _mean(c, t), 9: lambda l, t, c, r: _mean(t, r), 10: lambda l, t, c, r: _mean(_mean(l, c), _mean(t, r)),
    11: lambda l, t, c, r: _nearer(l, t, c), 12: lambda l, t, c, r: np.clip(l + t - c, 0, 255),
    13: lambda l, t, c, r: np.clip(_mean(l, t) + np.trunc((_mean(l, t) - c) / 2).astype(np.int32), 0, 255),
}
#: Modes that don't use the left pixel: whole runs at once.
RUNS = (2, 3, 4, 8, 9)


def predicted(mode: int, left, top, corner, right):
    return MODES[mode](left, top, corner, right) if mode in MODES else np.array([0, 0, 0, 255], np.int32)


def _add_prediction(out: np.ndarray, power: int, modes: np.ndarray) -> None:
    """The first pixel adds to opaque black, the rest of the first row to the left pixel, first columns to the top one."""
    height, width, _ = out.shape
    out[0, 0, 3] = int(out[0, 0, 3]) + 255 & 255
    out[0] = np.cumsum(out[0], axis=0, dtype=np.uint8)
    for y in range(1, height):
        row = out[y].astype(np.int32)
        above = out[y - 1].astype(np.int32)
        row[0] = row[0] + above[0] & 255
        above = np.concatenate([above, row[:1]])  # right of the last column comes this row's first pixel
        x = 1
        while x < width:
            end, mode = min(width, (x >> power) + 1 << power), int(modes[y >> power, x >> power, 1] & 15)
            if mode == 1:
                row[x:end] = row[x - 1] + np.cumsum(row[x:end], axis=0) & 255
            elif mode in RUNS or mode not in MODES:
                row[x:end] = row[x:end] + predicted(mode, None, above[x:end], above[x - 1 : end - 1], above[x + 1 : end + 1]) & 255
            else:
                for i in range(x, end):
                    row[i] = row[i] + predicted(mode, row[i - 1], above[i], above[i - 1], above[i + 1]) & 255
            x = end
        out[y] = row
