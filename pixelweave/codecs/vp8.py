"""Key frames of VP8, the lossy stream of WebP.

A frame is read in three steps: modes and coefficients of all macroblocks, then prediction and residuals block by block, then the
loop filter. The format's 3,000 default probabilities are no part of this package but a parameter: the text of the listings of the
format's standard (``coeff_update_probs``, ``default_coeff_probs``, ``kf_bmode_probs``).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from . import CodecError, damaged, need, unsupported
from .listing import listing

DC, V, H, TM, B = range(5)
B_DC, B_TM, B_VE, B_HE, B_LD, B_RD, B_VR, B_VL, B_HD, B_HU = range(10)
#: A block's mode that a macroblock's mode stands for among its neighbours.
AS_BLOCK = {DC: B_DC, V: B_VE, H: B_HE, TM: B_TM}
# Fixed values of the format: trees as pairs of branches (a leaf is ~value) with their probabilities, bands, extra bits, quantizers.
# fmt: off
MODE_TREE, MODE_PROBABILITIES = ((~B, 1), (2, 3), (~DC, ~V), (~H, ~TM)), (145, 156, 163, 128)
CHROMA_TREE, CHROMA_PROBABILITIES = ((~DC, 1), (~V, 2), (~H, ~TM)), (142, 114, 183)
BLOCK_TREE = ((~B_DC, 1), (~B_TM, 2), (~B_VE, 3), (4, 6), (~B_HE, 5), (~B_RD, ~B_VR), (~B_LD, 7), (~B_VL, 8), (~B_HD, ~B_HU))
SEGMENT_TREE = ((1, 2), (~0, ~1), (~2, ~3))
BANDS = (0, 1, 2, 3, 6, 4, 5, 6, 6, 6, 6, 6, 6, 6, 6, 7)
ZIGZAG = (0, 1, 4, 8, 5, 2, 3, 6, 9, 12, 13, 10, 7, 11, 14, 15)
EXTRA_BITS = ((173, 148, 140), (176, 155, 140, 135), (180, 157, 141, 134, 130), (254, 254, 243, 230, 196, 177, 153, 140, 133, 130, 129))
DC_QUANTIZERS = (
    4, 5, 6, 7, 8, 9, 10, 10, 11, 12, 13, 14, 15, 16, 17, 17, 18, 19, 20, 20, 21, 21, 22, 22, 23, 23, 24, 25, 25, 26, 27, 28,
    29, 30, 31, 32, 33, 34, 35, 36, 37, 37, 38, 39, 40, 41, 42, 43, 44, 45, 46, 46, 47, 48, 49, 50, 51, 52, 53, 54, 55, 56, 57, 58,
    59, 60, 61, 62, 63, 64, 65, 66, 67, 68, 69, 70, 71, 72, 73, 74, 75, 76, 76, 77, 78, 79, 80, 81, 82, 83, 84, 85, 86, 87, 88, 89,
    91, 93, 95, 96, 98, 100, 101, 102, 104, 106, 108, 110, 112, 114, 116, 118, 122, 124, 126, 128, 130, 132, 134, 136, 138, 140, 143, 145, 148, 151, 154, 157,
)
AC_QUANTIZERS = (
    4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25, 26, 27, 28, 29, 30, 31, 32, 33, 34, 35,
    36, 37, 38, 39, 40, 41, 42, 43, 44, 45, 46, 47, 48, 49, 50, 51, 52, 53, 54, 55, 56, 57, 58, 60, 62, 64, 66, 68, 70, 72, 74, 76,
    78, 80, 82, 84, 86, 88, 90, 92, 94, 96, 98, 100, 102, 104, 106, 108, 110, 112, 114, 116, 119, 122, 125, 128, 131, 134, 137, 140, 143, 146, 149, 152,
    155, 158, 161, 164, 167, 170, 173, 177, 181, 185, 189, 193, 197, 201, 205, 209, 213, 217, 221, 225, 229, 234, 239, 245, 249, 254, 259, 264, 269, 274, 279, 284,
)
# fmt: on


@dataclass(frozen=True)
class Tables:
    """Default probabilities: of coefficients, of changes of these, of blocks' modes (by the modes above and to the left)."""

    coefficients: np.ndarray
    updates: np.ndarray
    modes: np.ndarray

    @classmethod
    def read(cls, text: str) -> Tables:
        found = listing(text)
        pick = lambda shape, update: next((v for k, v in found.items() if v.shape == shape and ("update" in k.lower()) == update), None)
        tables = pick((4, 8, 3, 11), False), pick((4, 8, 3, 11), True), pick((10, 10, 9), False)
        if any(t is None or t.min() < 0 or t.max() > 255 for t in tables):
            raise CodecError("invalid_input", "the listings lack a table of VP8")
        return cls(*tables)


class Bools:
    """Arithmetic-coded bits. value is the coded number, low bits of it not yet looked at; what lies after the end is zeros."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.value, self.low, self.range = data, 0, 0, -8, 255

    def bit(self, probability: int) -> int:
        if self.low < 0:
            chunk = self.data[self.at : self.at + 32]
            self.at += 32
            self.value = self.value << 256 | int.from_bytes(chunk.ljust(32, b"\0"))
            self.low += 256
        split = 1 + ((self.range - 1) * probability >> 8)
        if one := self.value >> self.low >= split:
            self.value -= split << self.low
            self.range -= split
        else:
            self.range = split
        shift = 8 - self.range.bit_length()
        self.range <<= shift
        self.low -= shift
        return int(one)

    def number(self, bits: int) -> int:
        out = 0
        for _ in range(bits):
            out = out << 1 | self.bit(128)
        return out

    def flag(self) -> bool:
        return bool(self.bit(128))

    def signed(self, bits: int) -> int:
        value = self.number(bits)
        return -value if self.flag() else value

    def maybe(self, bits: int, other: int = 0) -> int:
        """A signed number that may be left out."""
        return self.signed(bits) if self.flag() else other

    def tree(self, tree, probabilities) -> int:
        node = 0
        while node >= 0:
            node = tree[node][self.bit(int(probabilities[node]))]
        return ~node


@dataclass
class Frame:
    """What a key frame says, macroblock by macroblock in rows."""

    width: int
    height: int
    across: int = 0
    down: int = 0
    simple: bool = False
    level: int = 0
    sharpness: int = 0
    use_segments: bool = False
    absolute: bool = False
    segment_quantizers: list[int] = field(default_factory=lambda: [0] * 4)
    segment_levels: list[int] = field(default_factory=lambda: [0] * 4)
    segment_probabilities: list[int] = field(default_factory=lambda: [255] * 3)
    use_deltas: bool = False
    reference_deltas: list[int] = field(default_factory=lambda: [0] * 4)
    mode_deltas: list[int] = field(default_factory=lambda: [0] * 4)
    quantizer: int = 0
    quantizer_deltas: list[int] = field(default_factory=lambda: [0] * 5)  # luma DC, second DC and AC, chroma DC and AC
    segment: np.ndarray | None = None
    mode: np.ndarray | None = None
    chroma_mode: np.ndarray | None = None
    blocks: np.ndarray | None = None  # modes of the 16 blocks
    values: np.ndarray | None = None  # coefficients by macroblock: 16 of luma, 4 and 4 of chroma, the second-order ones
    plain: np.ndarray | None = None  # macroblocks without coefficients


def dimensions(data: bytes) -> tuple[int, int]:
    head = need(data, 0, 10)
    if head[0] & 1:
        raise unsupported("only key frames of VP8 are read")
    if head[3:6] != b"\x9d\x01\x2a":
        raise damaged("not a key frame")
    width, height = (int.from_bytes(head[at : at + 2], "little") & 0x3FFF for at in (6, 8))
    if not width or not height:
        raise damaged("an empty frame")
    return width, height


def parse(data: bytes, tables: Tables) -> Frame:
    frame = Frame(*dimensions(data))
    frame.across, frame.down = -(-frame.width // 16), -(-frame.height // 16)
    size = int.from_bytes(data[:3], "little") >> 5
    b = Bools(need(data, 10, size))
    b.number(2)  # colour space and clamping
    update_map = _segments(b, frame)
    frame.simple, frame.level, frame.sharpness = b.flag(), b.number(6), b.number(3)
    frame.use_deltas = b.flag()
    if frame.use_deltas and b.flag():
        frame.reference_deltas = [b.maybe(6) for _ in range(4)]
        frame.mode_deltas = [b.maybe(6) for _ in range(4)]
    parts = _partitions(data, 10 + size, 1 << b.number(2))
    frame.quantizer, frame.quantizer_deltas = b.number(7), [b.maybe(4) for _ in range(5)]
    b.flag()  # whether later frames go on from these probabilities
    odds = tables.coefficients.copy()
    for place, update in np.ndenumerate(tables.updates):
        if b.bit(int(update)):
            odds[place] = b.number(8)
    may_skip = b.number(8) if b.flag() else None
    _macroblocks(b, frame, tables, parts, odds.tolist(), update_map, may_skip)
    return frame


def _segments(b: Bools, frame: Frame) -> bool:
    """Reads the segments' values; whether each macroblock tells its segment."""
    frame.use_segments = b.flag()
    if not frame.use_segments:
        return False
    update_map, update_values = b.flag(), b.flag()
    if update_values:
        frame.absolute = b.flag()
        frame.segment_quantizers = [b.maybe(7) for _ in range(4)]
        frame.segment_levels = [b.maybe(6) for _ in range(4)]
    if update_map:
        frame.segment_probabilities = [b.number(8) if b.flag() else 255 for _ in range(3)]
    return update_map


def _partitions(data: bytes, at: int, count: int) -> list[Bools]:
    sizes = need(data, at, 3 * (count - 1))
    at += 3 * (count - 1)
    out = []
    for i in range(count):
        size = int.from_bytes(sizes[3 * i : 3 * i + 3], "little") if i < count - 1 else len(data) - at
        if at > len(data):
            raise damaged("a partition begins after the end")
        out.append(Bools(data[at : at + size]))
        at += size
    return out


def _macroblocks(b: Bools, frame: Frame, tables: Tables, parts: list[Bools], odds: list, update_map: bool, may_skip: int | None) -> None:
    across, down = frame.across, frame.down
    frame.segment, frame.mode, frame.chroma_mode = (np.zeros((down, across), np.int64) for _ in range(3))
    frame.blocks = np.zeros((down, across, 4, 4), np.int64)
    frame.values, frame.plain = np.zeros((down, across, 25, 16), np.int64), np.zeros((down, across), bool)
    modes = tables.modes.tolist()
    above_modes = [B_DC] * (4 * across)
    above = [[0] * 9 for _ in range(across)]  # whether blocks had coefficients: 4 of luma, 2 and 2 of chroma, second-order
    for my in range(down):
        left_modes, left = [B_DC] * 4, [0] * 9
        for mx in range(across):
            if update_map:
                frame.segment[my, mx] = b.tree(SEGMENT_TREE, frame.segment_probabilities)
            skip = bool(b.bit(may_skip)) if may_skip is not None else False
            mode = frame.mode[my, mx] = b.tree(MODE_TREE, MODE_PROBABILITIES)
            for y in range(4):
                for x in range(4):
                    at = 4 * mx + x
                    own = b.tree(BLOCK_TREE, modes[above_modes[at]][left_modes[y]]) if mode == B else AS_BLOCK[int(mode)]
                    above_modes[at] = left_modes[y] = frame.blocks[my, mx, y, x] = own
            frame.chroma_mode[my, mx] = b.tree(CHROMA_TREE, CHROMA_PROBABILITIES)
            if skip:
                for own in (above[mx], left):
                    own[:8] = [0] * 8
                    if mode != B:
                        own[8] = 0
            some = not skip and _coefficients(parts[my % len(parts)], odds, frame.values[my, mx], above[mx], left, mode != B)
            frame.plain[my, mx] = not some


def _coefficients(b: Bools, odds: list, out: np.ndarray, above: list[int], left: list[int], second: bool) -> bool:
    some = False
    if second:
        above[8] = left[8] = got = _block(b, odds[1], above[8] + left[8], 0, out[24])
        some |= bool(got)
    for first, side, start, kind in ((0, 4, 0, 0 if second else 3), (16, 2, 4, 2), (20, 2, 6, 2)):
        for y in range(side):
            for x in range(side):
                got = _block(b, odds[kind], above[start + x] + left[start + y], 1 if kind == 0 else 0, out[first + y * side + x])
                above[start + x] = left[start + y] = got
                some |= bool(got)
    return some


def _block(b: Bools, odds: list, context: int, at: int, out: np.ndarray) -> int:
    """Coefficients of a block in natural order; 1 if it has any."""
    begun = at
    p = odds[BANDS[at]][context]
    while at < 16 and b.bit(p[0]):
        while not b.bit(p[1]):  # zeros, after which the block can't end
            at += 1
            if at == 16:
                return 1
            p = odds[BANDS[at]][0]
        value = 1
        if b.bit(p[2]):
            value = _large(b, p)
        out[ZIGZAG[at]] = -value if b.bit(128) else value
        at += 1
        if at < 16:
            p = odds[BANDS[at]][1 if value == 1 else 2]
    return int(at > begun)


def _large(b: Bools, p: list[int]) -> int:
    if not b.bit(p[3]):
        return 2 if not b.bit(p[4]) else 3 + b.bit(p[5])
    if not b.bit(p[6]):
        return 5 + b.bit(159) if not b.bit(p[7]) else 7 + 2 * b.bit(165) + b.bit(145)
    high = b.bit(p[8])
    kind = 2 * high + b.bit(p[9 + high])
    extra = 0
    for probability in EXTRA_BITS[kind]:
        extra = 2 * extra + b.bit(probability)
    return 3 + (8 << kind) + extra


def _scales(frame: Frame) -> np.ndarray:
    """Factors of the 25 blocks' coefficients by segment."""
    out = np.zeros((4, 25, 16), np.int64)
    for s in range(4):
        base = frame.quantizer
        if frame.use_segments:
            base = frame.segment_quantizers[s] + (0 if frame.absolute else base)
        at = [min(127, max(0, base + d)) for d in (0, *frame.quantizer_deltas)]
        out[s, :16], out[s, :16, 0] = AC_QUANTIZERS[min(127, max(0, base))], DC_QUANTIZERS[at[1]]
        out[s, 24], out[s, 24, 0] = max(8, AC_QUANTIZERS[at[3]] * 155 // 100), 2 * DC_QUANTIZERS[at[2]]
        out[s, 16:24], out[s, 16:24, 0] = AC_QUANTIZERS[at[5]], min(132, DC_QUANTIZERS[at[4]])
    return out


def walsh(values: np.ndarray) -> np.ndarray:
    """Inverse Walsh-Hadamard transform of (..., 4, 4)."""
    for axis, rounding in ((-2, 0), (-1, 3)):
        a, b, c, d = np.moveaxis(values, axis, 0)
        s, t, u, v = a + d, b + c, b - c, a - d
        values = np.stack([s + t, u + v, s - t, v - u], axis=axis) + rounding
    return values >> 3


def cosine(values: np.ndarray) -> np.ndarray:
    """Inverse cosine transform of (..., 4, 4), in the format's fixed point."""
    for axis, rounding in ((-2, 0), (-1, 4)):
        a, b, c, d = np.moveaxis(values, axis, 0)
        s, t = a + c, a - c
        u = (b * 35468 >> 16) - d - (d * 20091 >> 16)
        v = b + (b * 20091 >> 16) + (d * 35468 >> 16)
        values = np.stack([s + v, t + u, t - u, s - v], axis=axis) + rounding
    return values >> 3


def residuals(frame: Frame) -> np.ndarray:
    """(down, across, 24, 4, 4)."""
    values = frame.values * _scales(frame)[frame.segment]
    second = frame.mode != B
    values[second, :16, 0] = walsh(values[second, 24].reshape(-1, 4, 4)).reshape(-1, 16)
    return cosine(values[:, :, :24].reshape(frame.down, frame.across, 24, 4, 4))


def _picks() -> list[np.ndarray]:
    """For the directional modes, by mode - B_VE: which smoothed value of the edge each pixel is. The edge runs from the lowest pixel on
    the left (0) up to the corner (4) and along the row above to the right (12); the means of 2 from it follow at 14, those of 3 at 28."""
    two, three = 14, 28
    out = [np.zeros((4, 4), np.int64) for _ in range(8)]
    for r in range(4):
        for c in range(4):
            down, along = 2 * c - r, 2 * r - c
            out[0][r, c] = three + 5 + c
            out[1][r, c] = three + 3 - r
            out[2][r, c] = three + 6 + r + c
            out[3][r, c] = three + 4 - r + c
            out[4][r, c] = three + 5 + down if down < -1 else (three + 4 + c - r // 2 if r % 2 else two + 4 + c - r // 2)
            out[5][r, c] = three + (10 if r == 2 else 11) if c == 3 and r > 1 else (three + 6 if r % 2 else two + 5) + c + r // 2
            out[6][r, c] = three + 3 - along if along < -1 else (three + 4 - r + c // 2 if c % 2 else two + 3 - r + c // 2)
            k = 2 * r + c
            out[7][r, c] = 0 if k > 5 else (three if k % 2 else two) + 2 - k // 2
    return out


PICKS = _picks()


def predict_block(mode: int, edge: np.ndarray) -> np.ndarray:
    """4 x 4 pixels from the edge (13 values, as above)."""
    left, corner, above = edge[3::-1], edge[4], edge[5:9]
    if mode == B_DC:
        return np.full((4, 4), (left.sum() + above.sum() + 4) >> 3)
    if mode == B_TM:
        return np.clip(left[:, None] + above[None] - corner, 0, 255)
    x = np.concatenate([edge[:1], edge, edge[-1:]])
    smooth = np.concatenate([edge, edge[-1:], (x[1:] + np.append(x[2:], x[-1]) + 1) >> 1, (x[:-2] + 2 * x[1:-1] + x[2:] + 2) >> 2])
    return smooth[PICKS[mode - B_VE]]


def _predict(mode: int, plane: np.ndarray, y: int, x: int, side: int) -> np.ndarray:
    """A whole block of a plane with a border of one row and one column."""
    above, left = plane[y, x + 1 : x + 1 + side], plane[y + 1 : y + 1 + side, x]
    if mode == V:
        return np.broadcast_to(above, (side, side))
    if mode == H:
        return np.broadcast_to(left[:, None], (side, side))
    if mode == TM:
        return np.clip(left[:, None] + above[None] - plane[y, x], 0, 255)
    known = [e for e, there in ((above, y), (left, x)) if there]
    return np.full((side, side), (sum(int(e.sum()) for e in known) + len(known) * side // 2) // (len(known) * side) if known else 128)


def reconstruct(frame: Frame) -> list[np.ndarray]:
    """Three planes of whole macroblocks, with the border: a row of 127 above, a column of 129 to the left."""
    planes = []
    for side in (16, 8, 8):
        plane = np.zeros((frame.down * side + 1, frame.across * side + 1), np.int64)
        plane[1:, 0], plane[0] = 129, 127
        planes.append(plane)
    rest = residuals(frame)
    luma = planes[0]
    for my in range(frame.down):
        for mx in range(frame.across):
            own, y, x = rest[my, mx], 16 * my, 16 * mx
            if frame.mode[my, mx] == B:
                beyond = luma[y, x + 17 : x + 21] if mx + 1 < frame.across else np.repeat(luma[y, x + 16] if my else 127, 4)
                for i in range(4):
                    for j in range(4):
                        r, c = y + 4 * i, x + 4 * j
                        after = beyond if j == 3 else luma[r, c + 5 : c + 9]
                        edge = np.concatenate([luma[r + 4 : r : -1, c], luma[r, c : c + 5], after])
                        luma[r + 1 : r + 5, c + 1 : c + 5] = np.clip(predict_block(int(frame.blocks[my, mx, i, j]), edge) + own[4 * i + j], 0, 255)
            else:
                whole = own[:16].reshape(4, 4, 4, 4).swapaxes(1, 2).reshape(16, 16)
                luma[y + 1 : y + 17, x + 1 : x + 17] = np.clip(_predict(int(frame.mode[my, mx]), luma, y, x, 16) + whole, 0, 255)
            for k, plane in enumerate(planes[1:]):
                part = own[16 + 4 * k : 20 + 4 * k].reshape(2, 2, 4, 4).swapaxes(1, 2).reshape(8, 8)
                plane[8 * my + 1 : 8 * my + 9, 8 * mx + 1 : 8 * mx + 9] = np.clip(_predict(int(frame.chroma_mode[my, mx]), plane, 8 * my, 8 * mx, 8) + part, 0, 255)
    return planes


def _byte(x: np.ndarray) -> np.ndarray:
    return np.clip(x, -128, 127)


def filter_edge(lines: np.ndarray, edge: int, inner: int, sharp: int, outer: bool, simple: bool) -> None:
    """Smooths across the middle of lines (4 pixels on each side, a line a column), in place. outer: an edge of macroblocks."""
    p3, p2, p1, p0, q0, q1, q2, q3 = signed = lines - 128
    on = 2 * np.abs(p0 - q0) + (np.abs(p1 - q1) >> 1) <= edge
    taps = 3 * (q0 - p0)
    if simple:
        a = _byte(_byte(p1 - q1) + taps)
        signed[4], signed[3] = np.where(on, _byte(q0 - (_byte(a + 4) >> 3)), q0), np.where(on, _byte(p0 + (_byte(a + 3) >> 3)), p0)
    else:
        on &= (np.abs(np.diff(signed, axis=0))[[0, 1, 2, 4, 5, 6]] <= inner).all(axis=0)
        rough = (np.abs(p1 - p0) > sharp) | (np.abs(q1 - q0) > sharp)
        a = _byte(np.where(rough | outer, _byte(p1 - q1), 0) + taps)
        down, up = _byte(a + 4) >> 3, _byte(a + 3) >> 3
        if outer:
            steps = [_byte((27 - 9 * k) * a + 63 >> 7) for k in range(3)]
            minus = [np.where(rough, down, steps[0]), np.where(rough, 0, steps[1]), np.where(rough, 0, steps[2])]
            plus = [np.where(rough, up, steps[0]), *minus[1:]]
        else:
            minus = [down, np.where(rough, 0, (down + 1) >> 1)]
            plus = [up, minus[1]]
        for k, (m, n) in enumerate(zip(minus, plus, strict=True)):
            q, p = signed[4 + k].copy(), signed[3 - k].copy()
            signed[4 + k], signed[3 - k] = np.where(on, _byte(q - m), q), np.where(on, _byte(p + n), p)
    lines[:] = signed + 128


def loop_filter(frame: Frame, planes: list[np.ndarray]) -> None:
    """All edges, macroblock by macroblock: left, inside across, top, inside down. Planes are without their borders."""
    for my in range(frame.down):
        for mx in range(frame.across):
            level = frame.level
            if frame.use_segments:
                level = frame.segment_levels[frame.segment[my, mx]] + (0 if frame.absolute else level)
            if frame.use_deltas:
                level += frame.reference_deltas[0] + (frame.mode_deltas[0] if frame.mode[my, mx] == B else 0)
            level = min(63, max(0, level))
            if not level:
                continue
            inner = level >> (frame.sharpness > 0) + (frame.sharpness > 4)
            inner = max(1, min(inner, 9 - frame.sharpness) if frame.sharpness else inner)
            sharp = (level >= 15) + (level >= 40)
            inside = frame.mode[my, mx] == B or not frame.plain[my, mx]
            for axis in (1, 0):
                for side, plane in zip((16, 8, 8), planes, strict=True):
                    if frame.simple and side == 8:
                        continue
                    turned = plane if axis == 0 else plane.T
                    begin, along = ((my, mx) if axis == 0 else (mx, my))
                    cut = slice(side * along, side * along + side)
                    for at in range(side * begin, side * begin + side, 4):
                        outer = at == side * begin
                        if at and (outer or inside):
                            filter_edge(turned[at - 4 : at + 4, cut], 2 * (level + 2 * outer) + inner, inner, sharp, outer, frame.simple)


def decode(data: bytes, tables: Tables) -> np.ndarray:
    """RGBA of a key frame, opaque; chroma is the nearest sample's."""
    frame = parse(data, tables)
    planes = [p[1:, 1:] for p in reconstruct(frame)]
    loop_filter(frame, planes)
    y = planes[0][: frame.height, : frame.width] - 16
    rows, columns = np.arange(frame.height) // 2, np.arange(frame.width) // 2
    u, v = (p[rows][:, columns] - 128 for p in planes[1:])
    out = np.full((frame.height, frame.width, 4), 255, np.uint8)
    colours = (298 * y + 409 * v + 128 >> 8, 298 * y - 100 * u - 208 * v + 128 >> 8, 298 * y + 516 * u + 128 >> 8)
    for k, c in enumerate(colours):
        out[..., k] = np.clip(c, 0, 255)
    return out
