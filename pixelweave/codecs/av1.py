"""AV1 streams up to the tiles: units, sequence header, header of an intra frame, tile grid and byte ranges. No pixels."""

from __future__ import annotations

from types import SimpleNamespace

from . import damaged, need, unsupported

SEQUENCE, FRAME_HEADER, TILE_GROUP, FRAME = 1, 3, 4, 6
KEY, INTER, INTRA_ONLY, SWITCH = range(4)
SELECT, ALL_REFRESHED = 2, 0xFF
# Fixed values of the format: largest tile width and area; bits and signs of the segment features.
TILE_WIDTH, TILE_AREA, MOST_TILES = 4096, 4096 * 2304, 64
FEATURES = ((8, True), (6, True), (6, True), (6, True), (6, True), (3, False), (0, False), (0, False))


class Bits:
    """Big-endian bit reader."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def f(self, n: int) -> int:
        if self.at + n > 8 * len(self.data):
            raise damaged("the stream ends early")
        first, end = self.at >> 3, (self.at + n + 7) >> 3
        value = int.from_bytes(self.data[first:end], "big") >> (8 * end - self.at - n)
        self.at += n
        return value & ((1 << n) - 1)

    def flag(self) -> bool:
        return bool(self.f(1))

    def su(self, n: int) -> int:
        value = self.f(n)
        return value - (1 << n) if value >> (n - 1) else value

    def ns(self, n: int) -> int:
        """A value under n, the first ones in a bit less."""
        w = n.bit_length()
        m = (1 << w) - n
        value = self.f(w - 1)
        return value if value < m else (value << 1) - m + self.f(1)

    def uvlc(self) -> int:
        zeros = 0
        while not self.flag():
            zeros += 1
            if zeros == 32:
                return (1 << 32) - 1
        return self.f(zeros) + (1 << zeros) - 1

    def delta(self) -> int:
        return self.su(7) if self.flag() else 0

    def align(self) -> int:
        """The next whole byte's position."""
        self.at = (self.at + 7) & ~7
        return self.at >> 3


def leb128(data: bytes, at: int) -> tuple[int, int]:
    value = 0
    for i in range(8):
        byte = need(data, at + i, 1)[0]
        value |= (byte & 0x7F) << 7 * i
        if byte < 0x80:
            return value, at + i + 1
    raise damaged("a length goes on for over 8 bytes")


def units(data: bytes):
    """(type, temporal id, spatial id, first byte, length) of each unit; one without a size reaches to the end."""
    at = 0
    while at < len(data):
        head = data[at]
        if head & 0x80:
            raise damaged("a forbidden bit is set")
        at += 1
        layer = 0
        if head & 4:
            layer = need(data, at, 1)[0]
            at += 1
        size = len(data) - at
        if head & 2:
            size, at = leb128(data, at)
        need(data, at, size)
        yield head >> 3 & 15, layer >> 5, layer >> 3 & 3, at, size
        at += size


def sequence_header(body: bytes) -> SimpleNamespace:
    b, s = Bits(body), SimpleNamespace(presentation_bits=0, equal_interval=False, removal_bits=0, points=[(0, False)], id_bits=0, order_bits=0, screen_content=SELECT, integer_mv=SELECT)
    s.profile, s.still, s.reduced = b.f(3), b.flag(), b.flag()
    if s.profile > 2:
        raise damaged("unknown profile")
    if s.reduced:
        s.level = b.f(5)
    else:
        _operating_points(b, s)
    wide, high = b.f(4) + 1, b.f(4) + 1
    s.width_bits, s.height_bits, s.width, s.height = wide, high, b.f(wide) + 1, b.f(high) + 1
    if not s.reduced and b.flag():
        s.id_bits = b.f(4) + 2
        s.id_bits += b.f(3) + 1
    s.large_blocks, s.filter_intra, s.intra_edge = b.flag(), b.flag(), b.flag()
    if not s.reduced:
        b.f(4)  # compound and motion tools
        ordered = b.flag()
        if ordered:
            b.f(2)
        s.screen_content = SELECT if b.flag() else b.f(1)
        s.integer_mv = (SELECT if b.flag() else b.f(1)) if s.screen_content else SELECT
        if ordered:
            s.order_bits = b.f(3) + 1
    s.superres, s.cdef, s.restoration = b.flag(), b.flag(), b.flag()
    _colour(b, s)
    s.film_grain = b.flag()
    return s


def _operating_points(b: Bits, s: SimpleNamespace) -> None:
    delay_bits = 0
    if b.flag():
        b.f(64)
        s.equal_interval = b.flag()
        if s.equal_interval:
            b.uvlc()
        if b.flag():
            delay_bits = b.f(5) + 1
            b.f(32)
            s.removal_bits, s.presentation_bits = b.f(5) + 1, b.f(5) + 1
    initial, s.points = b.flag(), []
    for i in range(b.f(5) + 1):
        layers, level, modelled = b.f(12), b.f(5), False
        if level > 7:
            b.f(1)
        if delay_bits and b.flag():
            modelled = True
            b.f(2 * delay_bits + 1)
        if initial and b.flag():
            b.f(4)
        s.points.append((layers, modelled))
        if not i:
            s.level = level


def _colour(b: Bits, s: SimpleNamespace) -> None:
    high = b.flag()
    s.depth = (12 if b.flag() else 10) if high and s.profile == 2 else 10 if high else 8
    s.mono = s.profile != 1 and b.flag()
    s.primaries, s.transfer, s.matrix = (b.f(8), b.f(8), b.f(8)) if b.flag() else (2, 2, 2)
    s.separate_uv = False
    if s.mono:
        s.full_range, s.sub_x, s.sub_y = b.flag(), 1, 1
        return
    if (s.primaries, s.transfer, s.matrix) == (1, 13, 0):
        s.full_range, s.sub_x, s.sub_y = True, 0, 0
    else:
        s.full_range = b.flag()
        s.sub_x, s.sub_y = {0: (1, 1), 1: (0, 0), 2: (1, 0)}[s.profile]
        if s.profile == 2 and s.depth == 12:
            s.sub_x = b.f(1)
            s.sub_y = b.f(1) if s.sub_x else 0
        if s.sub_x and s.sub_y:
            b.f(2)
    s.separate_uv = b.flag()


def chroma(s: SimpleNamespace) -> str:
    return "400" if s.mono else {(1, 1): "420", (1, 0): "422", (0, 0): "444"}[s.sub_x, s.sub_y]


def frame_header(b: Bits, s: SimpleNamespace, temporal: int = 0, spatial: int = 0) -> SimpleNamespace:
    """The whole header of an intra frame, so that b stands behind it."""
    h = SimpleNamespace(kind=KEY, shown=True, showable=False)
    resilient = True
    if not s.reduced:
        if b.flag():
            raise unsupported("a shown frame of before holds no tiles")
        h.kind, h.shown = b.f(2), b.flag()
        if h.shown and s.removal_bits and not s.equal_interval:
            b.f(s.presentation_bits)
        h.showable = h.kind != KEY if h.shown else b.flag()
        if h.kind in (INTER, SWITCH):
            raise unsupported("only intra frames are read")
        resilient = (h.kind == KEY and h.shown) or b.flag()
    h.frozen = b.flag()
    h.screen_content = b.f(1) if s.screen_content == SELECT else s.screen_content
    if h.screen_content and s.integer_mv == SELECT:
        b.f(1)
    b.f(s.id_bits)
    own_size = not s.reduced and b.flag()
    b.f(s.order_bits)
    if s.removal_bits and b.flag():
        for layers, modelled in s.points:
            if modelled and (not layers or (layers >> temporal & 1 and layers >> (spatial + 8) & 1)):
                b.f(s.removal_bits)
    refresh = ALL_REFRESHED if h.kind == KEY and h.shown else b.f(8)
    if refresh != ALL_REFRESHED and resilient and s.order_bits:
        b.f(8 * s.order_bits)
    h.upscaled, h.height = (b.f(s.width_bits) + 1, b.f(s.height_bits) + 1) if own_size else (s.width, s.height)
    h.width = h.upscaled
    if s.superres and b.flag():
        scale = b.f(3) + 9
        h.width = (8 * h.upscaled + scale // 2) // scale
    if b.flag():
        b.f(32)  # size to render at
    h.block_copy = bool(h.screen_content) and h.upscaled == h.width and b.flag()
    if not s.reduced and not h.frozen:
        b.f(1)
    h.columns, h.rows = 2 * ((h.width + 7) >> 3), 2 * ((h.height + 7) >> 3)
    _tile_grid(b, s, h)
    _quantizers(b, s, h)
    _filters(b, s, h)
    if not h.lossless:
        b.f(1)  # transform sizes
    b.f(1)
    if s.film_grain and (h.shown or h.showable):
        _film_grain(b, s)
    return h


def log2_at_least(unit: int, target: int) -> int:
    k = 0
    while unit << k < target:
        k += 1
    return k


def _starts(b: Bits, blocks: int, least: int, most: int) -> tuple[list[int], int]:
    """Uniform tiles along one side, in superblocks."""
    k = least
    while k < most and b.flag():
        k += 1
    return list(range(0, blocks, (blocks + (1 << k) - 1) >> k)), k


def _own_starts(b: Bits, blocks: int, most: int) -> list[int]:
    starts, at = [], 0
    while at < blocks:
        starts.append(at)
        at += b.ns(min(blocks - at, most)) + 1
    if len(starts) > MOST_TILES:
        raise damaged("too many tiles")
    return starts


def _tile_grid(b: Bits, s: SimpleNamespace, h: SimpleNamespace) -> None:
    shift = 5 if s.large_blocks else 4
    across, down = ((n + (1 << shift) - 1) >> shift for n in (h.columns, h.rows))
    widest, area = TILE_WIDTH >> (shift + 2), TILE_AREA >> 2 * (shift + 2)
    least_across = log2_at_least(widest, across)
    least = max(least_across, log2_at_least(area, across * down))
    if b.flag():
        x, h.x_bits = _starts(b, across, least_across, log2_at_least(1, min(across, MOST_TILES)))
        y, h.y_bits = _starts(b, down, max(least - h.x_bits, 0), log2_at_least(1, min(down, MOST_TILES)))
    else:
        x = _own_starts(b, across, widest)
        broad = max(q - p for p, q in zip(x, [*x[1:], across], strict=True))
        room = across * down >> (least + 1) if least else across * down
        y = _own_starts(b, down, max(room // broad, 1))
        h.x_bits, h.y_bits = log2_at_least(1, len(x)), log2_at_least(1, len(y))
    h.size_bytes = 0
    if h.x_bits or h.y_bits:
        b.f(h.x_bits + h.y_bits)
        h.size_bytes = b.f(2) + 1
    h.x = [*(v << shift for v in x), h.columns]
    h.y = [*(v << shift for v in y), h.rows]


def _quantizers(b: Bits, s: SimpleNamespace, h: SimpleNamespace) -> None:
    """Quantizers, segments and their deltas; lossless where all of them are zero."""
    h.quantizer = b.f(8)
    deltas = [b.delta()]
    if not s.mono:
        apart = s.separate_uv and b.flag()
        deltas += [b.delta() for _ in range(4 if apart else 2)]
    if b.flag():
        b.f(8 if s.mono or not s.separate_uv else 12)
    h.segments = [{} for _ in range(8)]
    if enabled := b.flag():
        for segment in h.segments:
            for i, (bits, signed) in enumerate(FEATURES):
                if b.flag():
                    segment[i] = b.su(bits + 1) if signed else b.f(bits)
    levels = [max(0, min(255, h.quantizer + seg.get(0, 0))) for seg in (h.segments if enabled else [{}])]
    h.lossless = not any(levels) and not any(deltas)
    if h.quantizer and b.flag():
        b.f(2)
        if not h.block_copy and b.flag():
            b.f(3)


def _filters(b: Bits, s: SimpleNamespace, h: SimpleNamespace) -> None:
    """Deblocking, directional enhancement, restoration."""
    planes = 1 if s.mono else 3
    h.deblock, h.restoration = (0, 0), [0] * planes
    if not h.lossless and not h.block_copy:
        h.deblock = (b.f(6), b.f(6))
        if planes > 1 and any(h.deblock):
            b.f(12)
        b.f(3)
        if b.flag() and b.flag():
            for _ in range(10):
                b.delta()
        if s.cdef:
            b.f(2)
            b.f((6 if planes == 1 else 12) << b.f(2))
    if (h.lossless and h.width == h.upscaled) or h.block_copy or not s.restoration:
        return
    h.restoration = [b.f(2) for _ in range(planes)]
    if any(h.restoration):
        if b.flag() and not s.large_blocks:
            b.f(1)
        if s.sub_x and s.sub_y and any(h.restoration[1:]):
            b.f(1)


def _film_grain(b: Bits, s: SimpleNamespace) -> None:
    if not b.flag():
        return
    b.f(16)
    luma = b.f(4)
    b.f(16 * luma)
    from_luma = not s.mono and b.flag()
    blue = red = 0
    if not (s.mono or from_luma or (s.sub_x and s.sub_y and not luma)):
        blue = b.f(4)
        b.f(16 * blue)
        red = b.f(4)
        b.f(16 * red)
    b.f(2)
    lag = b.f(2)
    near = 2 * lag * (lag + 1)
    if luma:
        b.f(8 * near)
    for used in (blue, red):
        if used or from_luma:
            b.f(8 * (near + bool(luma)))
    b.f(4)
    for used in (blue, red):
        if used:
            b.f(25)
    b.f(2)


def tiles(data: bytes, config: bytes = b"") -> tuple[SimpleNamespace, SimpleNamespace, list[dict]]:
    """Sequence header, frame header and the tiles of the first frame; config: units that come before (from av1C)."""
    sequence = frame = None
    out: list[dict] = []
    for kind, _, _, at, size in units(config):
        if kind == SEQUENCE:
            sequence = sequence_header(config[at : at + size])
    for kind, temporal, spatial, at, size in units(data):
        body = data[at : at + size]
        if kind == SEQUENCE:
            sequence = sequence_header(body)
        elif kind in (FRAME_HEADER, FRAME) and frame is None:
            if sequence is None:
                raise damaged("a frame without a sequence header")
            b = Bits(body)
            frame = frame_header(b, sequence, temporal, spatial)
            if kind == FRAME:
                out += _group(body, b.align(), at, frame)
        elif kind == TILE_GROUP and frame is not None:
            out += _group(body, 0, at, frame)
        if frame is not None and len(out) >= (len(frame.x) - 1) * (len(frame.y) - 1):
            break
    if frame is None:
        raise damaged("no frame")
    return sequence, frame, out


def _group(body: bytes, start: int, at: int, h: SimpleNamespace):
    columns, rows = len(h.x) - 1, len(h.y) - 1
    b = Bits(body)
    b.at = 8 * start
    first, last = 0, columns * rows - 1
    if last and b.flag():
        first, last = b.f(h.x_bits + h.y_bits), b.f(h.x_bits + h.y_bits)
    if not first <= last < columns * rows:
        raise damaged("wrong tile numbers")
    p = b.align()
    for num in range(first, last + 1):
        size = len(body) - p
        if num < last:
            size = int.from_bytes(need(body, p, h.size_bytes), "little") + 1
            p += h.size_bytes
        need(body, p, size)
        row, column = divmod(num, columns)
        yield {"num": num, "row": row, "col": column, "size": size, "offset": at + p, "mi_row_start": h.y[row], "mi_row_end": h.y[row + 1], "mi_col_start": h.x[column], "mi_col_end": h.x[column + 1]}
        p += size
