"""TrueType fonts: files by family name, outlines, and texts as coverage of pixels."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterable

import numpy as np

#: Where fonts are looked for, and the family that stands in for one that isn't found.
FOLDERS = ("/usr/share/fonts", "/usr/local/share/fonts", "~/.fonts", "~/.local/share/fonts")
STAND_IN = "SF Pro"
#: Lines a pixel's coverage is taken from; pieces of a curve.
LINES, PIECES = 16, 8


class Font:
    """Outlines and widths in font units, y upwards. Raises ValueError for files that aren't TrueType or are damaged."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        try:
            if data[:4] not in (b"\0\1\0\0", b"true"):
                raise ValueError("no TrueType outlines")
            (count,) = struct.unpack_from(">H", data, 4)
            self.tables = {data[12 + 16 * i : 16 + 16 * i]: struct.unpack_from(">II", data, 20 + 16 * i) for i in range(count)}
            head, hhea = self._table(b"head"), self._table(b"hhea")
            self.wide = struct.unpack_from(">h", head, 50)[0]
            self.ascent, self.descent = struct.unpack_from(">hh", hhea, 4)
            self.widths = struct.unpack_from(">H", hhea, 34)[0]
            self.glyphs = struct.unpack_from(">H", self._table(b"maxp"), 4)[0]
            self.hmtx, self.glyf = self._table(b"hmtx"), self._table(b"glyf")
            self.loca = struct.unpack_from(f">{self.glyphs + 1}{'I' if self.wide else 'H'}", self._table(b"loca"))
            self.places = self._characters()
        except (struct.error, KeyError, IndexError) as error:
            raise ValueError(f"damaged font: {error}") from error

    def _table(self, name: bytes) -> bytes:
        at, size = self.tables[name]
        return self.data[at : at + size]

    def names(self) -> set[str]:
        """Family names, the ones with a style other than the regular one without it left out."""
        raw = self._table(b"name")
        count, start = struct.unpack_from(">HH", raw, 2)
        found: dict[int, set[str]] = {}
        for i in range(count):
            platform, _, _, kind, size, at = struct.unpack_from(">6H", raw, 6 + 12 * i)
            text = raw[start + at : start + at + size].decode("utf-16-be" if platform in (0, 3) else "latin-1", "replace")
            found.setdefault(kind, set()).add(text.lower())
        style = found.get(17) or found.get(2) or {"regular"}
        families = found.get(16, set()) | found.get(1, set())
        plain = bool(style & {"regular", "book", "roman", "normal"})
        return families | found.get(4, set()) if plain else found.get(4, set())

    def _characters(self) -> dict[int, int]:
        raw = self._table(b"cmap")
        (count,) = struct.unpack_from(">H", raw, 2)
        starts = sorted((struct.unpack_from(">HHI", raw, 4 + 8 * i) for i in range(count)), key=lambda x: (x[0], x[1]))
        out: dict[int, int] = {}
        for platform, _, at in starts:
            (form,) = struct.unpack_from(">H", raw, at)
            if platform not in (0, 3):
                continue
            if form == 12:
                for i in range(struct.unpack_from(">I", raw, at + 12)[0]):
                    first, last, glyph = struct.unpack_from(">III", raw, at + 16 + 12 * i)
                    out.update(zip(range(first, min(last, first + self.glyphs) + 1), range(glyph, self.glyphs), strict=False))
            elif form == 4:
                n = struct.unpack_from(">H", raw, at + 6)[0] // 2
                ends, begins, shifts, offsets = (struct.unpack_from(f">{n}H", raw, at + 14 + 2 * n * k + 2 * (k > 0)) for k in range(4))
                for i in range(n):
                    for c in range(begins[i], min(ends[i], 0xFFFE) + 1):
                        glyph = c
                        if offsets[i]:
                            (glyph,) = struct.unpack_from(">H", raw, at + 16 + 6 * n + 2 * i + offsets[i] + 2 * (c - begins[i]))
                        if glyph := (glyph + shifts[i]) & 0xFFFF if glyph else 0:
                            out.setdefault(c, glyph)
        return out

    def width(self, glyph: int) -> int:
        return struct.unpack_from(">H", self.hmtx, 4 * min(glyph, self.widths - 1))[0]

    def contours(self, glyph: int, depth: int = 0) -> list[np.ndarray]:
        """Closed lines of points (x, y), curves cut into pieces."""
        scale = 1 if self.wide else 2
        if not 0 <= glyph < self.glyphs or depth > 8:
            return []
        begin, end = scale * self.loca[glyph], scale * self.loca[glyph + 1]
        if end - begin < 10:
            return []
        raw = self.glyf[begin:end]
        (count,) = struct.unpack_from(">h", raw)
        return self._simple(raw, count) if count >= 0 else self._parts(raw, depth)

    def _simple(self, raw: bytes, count: int) -> list[np.ndarray]:
        ends = struct.unpack_from(f">{count}H", raw, 10)
        total = ends[-1] + 1 if count else 0
        at = 10 + 2 * count
        at += 2 + struct.unpack_from(">H", raw, at)[0]  # instructions
        flags: list[int] = []
        while len(flags) < total:
            flag, at = raw[at], at + 1
            again = 0
            if flag & 8:
                again, at = raw[at], at + 1
            flags += [flag] * (again + 1)
        axes = []
        for short, same in ((2, 16), (4, 32)):
            now, values = 0, []
            for flag in flags[:total]:
                if flag & short:
                    now, at = now + (raw[at] if flag & same else -raw[at]), at + 1
                elif not flag & same:
                    now, at = now + struct.unpack_from(">h", raw, at)[0], at + 2
                values.append(now)
            axes.append(values)
        points = list(zip(*axes, (bool(f & 1) for f in flags[:total]), strict=True))
        return [_curve(points[a : b + 1]) for a, b in zip([0, *(e + 1 for e in ends[:-1])], ends, strict=True) if b > a]

    def _parts(self, raw: bytes, depth: int) -> list[np.ndarray]:
        out, at = [], 10
        while True:
            flags, part = struct.unpack_from(">HH", raw, at)
            at += 4
            form = ">hh" if flags & 1 else ">bb"
            move = struct.unpack_from(form, raw, at) if flags & 2 else (0, 0)
            at += struct.calcsize(form)
            n = 1 if flags & 8 else 2 if flags & 64 else 4 if flags & 128 else 0
            values = [v / 16384 for v in struct.unpack_from(f">{n}h", raw, at)]
            at += 2 * n
            a, b, c, d = {0: (1, 0, 0, 1), 1: (*values[:1], 0, 0, *values[:1]), 2: (*values[:1], 0, 0, *values[1:]), 4: tuple(values)}[n]
            out += [line @ np.array([[a, b], [c, d]]) + np.array(move) for line in self.contours(part, depth + 1)]
            if not flags & 32:
                return out


def _curve(points: list[tuple[int, int, bool]]) -> np.ndarray:
    """A contour of points on and off the curve (quadratic; between two off the curve lies one on it) as a closed line."""
    full = []
    for (x, y, on), (u, v, then) in zip(points, points[1:] + points[:1], strict=True):
        full.append((x, y, on))
        if not on and not then:
            full.append(((x + u) / 2, (y + v) / 2, True))
    first = next((i for i, p in enumerate(full) if p[2]), 0)
    full = full[first:] + full[: first + 1]
    line = [full[0][:2]]
    steps = np.arange(1, PIECES + 1) / PIECES
    for i in range(1, len(full)):
        x, y, on = full[i]
        if not on and i + 1 < len(full):
            (a, b), (u, v, _) = line[-1], full[i + 1]
            line += [((1 - t) ** 2 * a + 2 * t * (1 - t) * x + t * t * u, (1 - t) ** 2 * b + 2 * t * (1 - t) * y + t * t * v) for t in steps]
        elif full[i - 1][2]:
            line.append((x, y))
    return np.array(line, float)


def find(family: str, folders: Iterable[str] = FOLDERS) -> Font | None:
    """The first font, in order of paths, of that family; else of the one that stands in; else none."""
    named: dict[str, Font] = {}
    for folder in folders:
        for top, _, names in sorted(os.walk(os.path.expanduser(folder))):
            for name in sorted(names):
                if name.lower().endswith(".ttf"):
                    try:
                        with open(os.path.join(top, name), "rb") as f:
                            font = Font(f.read())
                        for own in font.names() & {family.lower(), STAND_IN.lower()}:
                            named.setdefault(own, font)
                    except (ValueError, KeyError, struct.error, OSError):
                        continue
        if family.lower() in named:
            break
    return named.get(family.lower()) or named.get(STAND_IN.lower())


def coverage(lines: list[np.ndarray]) -> tuple[int, int, np.ndarray]:
    """Left, top and share of each pixel that closed lines (y downwards) cover, where they wind round it."""
    if not lines:
        return 0, 0, np.zeros((0, 0))
    every = np.concatenate(lines)
    (left, top), (right, bottom) = np.floor(every.min(axis=0)).astype(int), np.ceil(every.max(axis=0)).astype(int)
    out = np.zeros((bottom - top, right - left + 2))
    begin, end = (np.concatenate([x[k : len(x) - 1 + k] for x in lines]) for k in (0, 1))
    for row in range(bottom - top):
        for line in range(LINES):
            y = top + row + (line + 0.5) / LINES
            crossing = (begin[:, 1] <= y) != (end[:, 1] <= y)
            (x0, y0), (x1, y1) = begin[crossing].T, end[crossing].T
            at = x0 + (y - y0) * (x1 - x0) / (y1 - y0) - left
            order = np.argsort(at, kind="stable")
            at, winds = at[order], np.cumsum(np.where(y1 > y0, 1, -1)[order])
            for a, b, w in zip(at[:-1], at[1:], winds[:-1], strict=True):
                if w and b > a:
                    i, j = int(a), int(b)
                    if i == j:
                        out[row, i] += b - a
                    else:
                        out[row, i] += i + 1 - a
                        out[row, i + 1 : j] += 1
                        out[row, j] += b - j
    return int(left), int(top), np.minimum(out[:, : right - left] / LINES, 1.0)


def text_coverage(font: Font, text: str, x: float, y: float, size: float) -> list[tuple[int, int, int, float]]:
    """(glyph's number in the text, x, y, share) of the pixels that a text covers; y is the top of its line, size its height."""
    scale = size / (font.ascent - font.descent)
    baseline, out = y + font.ascent * scale, []
    for number, c in enumerate(text):
        glyph = font.places.get(ord(c), 0)
        left, top, share = coverage([line * [scale, -scale] + [x, baseline] for line in font.contours(glyph)])
        rows, columns = np.nonzero(share)
        out += [(number, left + int(j), top + int(i), float(share[i, j])) for i, j in zip(rows, columns, strict=True)]
        x += font.width(glyph) * scale
    return out
