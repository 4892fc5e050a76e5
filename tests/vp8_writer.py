"""A plain writer of VP8 key frames for the tests: an arithmetic coder on exact numbers, and the syntax in order."""

import numpy as np

from pixelweave.codecs import vp8


def tables(seed=0):
    """Probabilities made up by a rule; the format's own are no part of the package."""
    rng = np.random.default_rng(seed)
    return vp8.Tables(rng.integers(1, 256, (4, 8, 3, 11)), rng.integers(200, 256, (4, 8, 3, 11)), rng.integers(1, 256, (10, 10, 9)))


def listings(t):
    braces = lambda x: "{" + ", ".join(braces(y) for y in x) + "}" if isinstance(x, list) else str(x)
    sizes = lambda x: "".join(f" [{n}]" for n in x.shape)
    return "\n".join(f"const Prob {name}{sizes(x)} =\n{braces(x.tolist())}; /* {name} */" for name, x in (("coeff_update_probs", t.updates), ("default_coeff_probs", t.coefficients), ("kf_bmode_probs", t.modes)))


class Writer:
    def __init__(self):
        self.low, self.range, self.bits = 0, 255, 8

    def bit(self, probability, value):
        split = 1 + ((self.range - 1) * int(probability) >> 8)
        if value:
            self.low, self.range = self.low + split, self.range - split
        else:
            self.range = split
        shift = 8 - self.range.bit_length()
        self.low, self.range, self.bits = self.low << shift, self.range << shift, self.bits + shift

    def number(self, n, value):
        for i in range(n - 1, -1, -1):
            self.bit(128, value >> i & 1)

    def maybe(self, n, value):
        self.bit(128, value != 0)
        if value:
            self.number(n, abs(value))
            self.bit(128, value < 0)

    def tree(self, tree, probabilities, value):
        def path(node):
            for side in (0, 1):
                then = tree[node][side]
                if then == ~value:
                    return [(node, side)]
                if then >= 0 and (rest := path(then)):
                    return [(node, side), *rest]
            return None

        for node, side in path(0):
            self.bit(probabilities[node], side)

    def data(self):
        pad = -self.bits % 8
        return (self.low << pad).to_bytes((self.bits + pad) // 8, "big") + bytes(2)


def block(w, odds, context, at, values):
    """The tokens of a block, values in natural order; whether there are any."""
    line = [int(values[z]) for z in vp8.ZIGZAG]
    end = max((i + 1 for i in range(at, 16) if line[i]), default=at)
    begun, p, after_zero = at, odds[vp8.BANDS[at]][context], False
    while at < 16:
        if not after_zero:
            w.bit(p[0], at < end)
            if at >= end:
                break
        v = abs(line[at])
        w.bit(p[1], v > 0)
        if v:
            w.bit(p[2], v > 1)
            if v > 1:
                w.bit(p[3], v > 4)
                if v <= 4:
                    w.bit(p[4], v > 2)
                    if v > 2:
                        w.bit(p[5], v == 4)
                else:
                    w.bit(p[6], v > 10)
                    if v <= 10:
                        w.bit(p[7], v > 6)
                        if v <= 6:
                            w.bit(159, v == 6)
                        else:
                            w.bit(165, v > 8)
                            w.bit(145, (v - 7) % 2)
                    else:
                        kind = max(k for k in range(4) if v >= 3 + (8 << k))
                        w.bit(p[8], kind >> 1)
                        w.bit(p[9 + (kind >> 1)], kind & 1)
                        extra, bits = v - 3 - (8 << kind), vp8.EXTRA_BITS[kind]
                        for i, q in enumerate(bits):
                            w.bit(q, extra >> len(bits) - 1 - i & 1)
            w.bit(128, line[at] < 0)
        at += 1
        after_zero = not v
        if at < 16:
            p = odds[vp8.BANDS[at]][min(v, 2)]
    return int(at > begun)


def write(f, t, parts=1, changed=None, skips=True):
    """The bytes of a frame (see vp8.Frame). changed: places of probabilities and their new values."""
    w, odds = Writer(), t.coefficients.copy()
    w.number(2, 0)
    w.bit(128, f.use_segments)
    if f.use_segments:
        w.number(2, 3)
        w.bit(128, f.absolute)
        for v in f.segment_quantizers:
            w.maybe(7, v)
        for v in f.segment_levels:
            w.maybe(6, v)
        for v in f.segment_probabilities:
            w.bit(128, v != 255)
            if v != 255:
                w.number(8, v)
    w.bit(128, f.simple)
    w.number(6, f.level)
    w.number(3, f.sharpness)
    w.bit(128, f.use_deltas)
    if f.use_deltas:
        w.bit(128, 1)
        for v in (*f.reference_deltas, *f.mode_deltas):
            w.maybe(6, v)
    w.number(2, parts.bit_length() - 1)
    w.number(7, f.quantizer)
    for v in f.quantizer_deltas:
        w.maybe(4, v)
    w.bit(128, 0)
    for place, p in np.ndenumerate(t.updates):
        new = (changed or {}).get(place)
        w.bit(p, new is not None)
        if new is not None:
            w.number(8, new)
            odds[place] = new
    w.bit(128, skips)
    if skips:
        w.number(8, 100)
    tokens = [Writer() for _ in range(parts)]
    above_modes, above = [0] * (4 * f.across), [[0] * 9 for _ in range(f.across)]
    for my in range(f.down):
        left_modes, left = [0] * 4, [0] * 9
        for mx in range(f.across):
            if f.use_segments:
                w.tree(vp8.SEGMENT_TREE, f.segment_probabilities, int(f.segment[my, mx]))
            values, mode, up = f.values[my, mx], int(f.mode[my, mx]), above[mx]
            skip = skips and not values.any()
            if skips:
                w.bit(100, skip)
            w.tree(vp8.MODE_TREE, vp8.MODE_PROBABILITIES, mode)
            for y in range(4):
                for x in range(4):
                    own = int(f.blocks[my, mx, y, x])
                    if mode == vp8.B:
                        w.tree(vp8.BLOCK_TREE, t.modes[above_modes[4 * mx + x], left_modes[y]], own)
                    above_modes[4 * mx + x] = left_modes[y] = own
            w.tree(vp8.CHROMA_TREE, vp8.CHROMA_PROBABILITIES, int(f.chroma_mode[my, mx]))
            if skip:
                up[:8] = left[:8] = [0] * 8
                if mode != vp8.B:
                    up[8] = left[8] = 0
                continue
            out = tokens[my % parts]
            if mode != vp8.B:
                up[8] = left[8] = block(out, odds[1], up[8] + left[8], 0, values[24])
            for first, side, start, kind in ((0, 4, 0, 3 if mode == vp8.B else 0), (16, 2, 4, 2), (20, 2, 6, 2)):
                for y in range(side):
                    for x in range(side):
                        up[start + x] = left[start + y] = block(out, odds[kind], up[start + x] + left[start + y], int(kind == 0), values[first + side * y + x])
    first, rest = w.data(), [x.data() for x in tokens]
    head = (len(first) << 5 | 1 << 4).to_bytes(3, "little") + b"\x9d\x01\x2a" + f.width.to_bytes(2, "little") + f.height.to_bytes(2, "little")
    return head + first + b"".join(len(x).to_bytes(3, "little") for x in rest[:-1]) + b"".join(rest)


def frame(width, height, rng, **more):
    f = vp8.Frame(width, height, -(-width // 16), -(-height // 16), **more)
    shape = (f.down, f.across)
    f.segment = rng.integers(0, 4, shape) if f.use_segments else np.zeros(shape, int)
    f.mode, f.chroma_mode = rng.integers(0, 5, shape), rng.integers(0, 4, shape)
    f.blocks = rng.integers(0, 10, (*shape, 4, 4))
    for m, b in vp8.AS_BLOCK.items():
        f.blocks[f.mode == m] = b
    f.values = rng.integers(-3, 4, (*shape, 25, 16)) * (rng.random((*shape, 25, 16)) < 0.2)
    f.values += (rng.random(f.values.shape) < 0.01) * rng.integers(-2000, 2001, f.values.shape)
    f.values[f.mode == vp8.B, 24] = 0
    f.values[f.mode != vp8.B, :16, 0] = 0
    f.values[rng.random(shape) < 0.2] = 0
    return f
