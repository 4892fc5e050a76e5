"""Symbols written by a plain arithmetic coder and read back, listings, and colours against formulas by hand."""

import random

import numpy as np
import pytest

from pixelweave.codecs import CodecError
from pixelweave.codecs import av1_symbols as av1
from pixelweave.codecs.listing import listing


def adapted(cdf, symbol):
    n = len(cdf) - 1
    rate = 3 + (cdf[n] > 15) + (cdf[n] > 31) + min(int(np.log2(n)), 2)
    for i in range(n - 1):
        cdf[i] += (32768 - cdf[i]) >> rate if i >= symbol else -(cdf[i] >> rate)
    cdf[n] = min(32, cdf[n] + 1)


class Coder:
    """Exact numbers: the low end of the range, all bits of it, and the range."""

    def __init__(self):
        self.low, self.range, self.bits = 0, 1 << 15, 15

    def put(self, cdf, symbol):
        n = len(cdf) - 1
        ends = [self.range] + [((self.range >> 8) * ((32768 - cdf[i]) >> 6) >> 1) + 4 * (n - 1 - i) for i in range(n)]
        self.low, self.range = self.low + ends[symbol + 1], ends[symbol] - ends[symbol + 1]
        while self.range < 1 << 15:
            self.low, self.range, self.bits = self.low << 1, self.range << 1, self.bits + 1

    def data(self):
        """Any value in the range, of which the last 15 bits are a one and zeros."""
        for size in range(-(-(self.bits - 14) // 8), self.bits // 8 + 4):
            more = 8 * size - self.bits
            one = self.bits - min(15, more + 15)
            after = 8 * size - one - 1
            tail = 1 << after if after >= 0 else None
            if tail is None:
                continue
            low, high = self.low << 64, self.low + self.range << 64
            total = self.bits + 64
            # the first `one` bits are free
            start = ~(high - 1) & ((1 << total) - 1)
            for first in range(start >> total - one, (start >> total - one) + 3):
                whole = (first << after + 1 | tail) << max(0, total - 8 * size) if total >= 8 * size else None
                if whole is not None and low <= ~whole & ((1 << total) - 1) < high and 0 <= first < 1 << one:
                    return (first << after + 1 | tail).to_bytes(size, "big")
        raise AssertionError("no end found")


@pytest.mark.parametrize("adapt", [True, False])
def test_symbols(adapt):
    rng = random.Random(4)
    for _ in range(30):
        tables = []
        for n in (2, 3, 4, 8, 13, 16):
            cuts = sorted(rng.sample(range(40, 32700), n - 1))
            tables.append([*cuts, 32768, 0])
        coder, own, plan = Coder(), [list(t) for t in tables], []
        for _ in range(rng.randrange(1, 200)):
            if rng.random() < 0.2:
                value = rng.randrange(1, 50)
                plan.append((None, value))
                for b in range(7, -1, -1):
                    coder.put([1 << 14, 1 << 15, 0], value >> b & 1)
            else:
                k = rng.randrange(len(own))
                s = rng.randrange(len(own[k]) - 1)
                plan.append((k, s))
                coder.put(own[k], s)
                if adapt:
                    adapted(own[k], s)
        reader, mine = av1.Symbols(coder.data(), adapt), [np.array(t, np.int32) for t in tables]
        for k, s in plan:
            assert (reader.literal(8) if k is None else reader.symbol(mine[k])) == s
        assert [m.tolist() for m in mine] == own
        reader.finish()


def test_numbers_below():
    rng = random.Random(5)
    for n in (1, 2, 3, 5, 8, 100):
        for value in {0, n - 1, rng.randrange(n)}:
            coder = Coder()
            width = n.bit_length()
            short = (1 << width) - n
            bits = [] if n == 1 else [value >> b & 1 for b in range(width - 2, -1, -1)] if value < short else [(value + short) >> b & 1 for b in range(width - 1, -1, -1)]
            for b in bits:
                coder.put([1 << 14, 1 << 15, 0], b)
            assert av1.Symbols(coder.data()).below(n) == value


def test_ends():
    reader = av1.Symbols(b"\x12")
    reader.literal(12)
    with pytest.raises(CodecError):
        reader.finish()
    with pytest.raises(CodecError):
        av1.Symbols(bytes(8)).finish()


LISTING = """
// some words
Default_Skip_Cdf[ SKIP_CONTEXTS ][ 3 ] = {
  { 31671, 32768, 0 }, { 16515, 32768, 0 } /* end */
}
Default_Dc_Sign_Cdf[ 4 ][ 2 ][ 3 ] = { { {1000, 32768, 0}, {1, 32768, 0} }, {{2000, 32768, 0}, {2, 32768, 0}}, {{3000, 32768, 0}, {3, 32768, 0}}, {{4000, 32768, 0}, {4, 32768, 0}} }
"""


def test_distributions():
    tables = listing(LISTING)
    assert {k: v.shape for k, v in tables.items()} == {"Default_Skip_Cdf": (2, 3), "Default_Dc_Sign_Cdf": (4, 2, 3)}
    for quantizer, share in ((0, 1000), (20, 1000), (21, 2000), (60, 2000), (61, 3000), (120, 3000), (121, 4000), (255, 4000)):
        assert av1.Distributions(tables, quantizer)["Default_Dc_Sign_Cdf", 0].tolist() == [share, 32768, 0]
    own = av1.Distributions(tables)
    av1.Symbols(bytes(9)).symbol(own["Default_Skip_Cdf", 1])
    assert own["Default_Skip_Cdf", 1].tolist() != [16515, 32768, 0] and tables["Default_Skip_Cdf"][1].tolist() == [16515, 32768, 0]
    with pytest.raises(KeyError):
        own["Default_Skip_Cdf"]
    with pytest.raises(CodecError):
        av1.Distributions({"x": np.array([[5, 3, 0]])})
    with pytest.raises(CodecError):
        listing("a[2][2] = { {1, 2}, {3} }")


def test_colours():
    grey = np.array([[0, 16, 128, 255]], np.uint8)
    assert av1.planes_to_rgba([grey], 8, 1, True)[0, :, 0].tolist() == [0, 16, 128, 255]
    assert av1.planes_to_rgba([grey], 8, 1, False)[0, :, 1].tolist() == [0, 16, 128, 255]
    ten = av1.planes_to_rgba([np.full((2, 2), 1023, np.uint16)] + [np.full((1, 1), 511, np.uint16)] * 2, 10, 1, True)
    assert ten.tolist() == [[[255] * 4] * 2] * 2
    y, u, v = 100, 90, 200
    got = av1.planes_to_rgba([np.full((3, 5), y, np.uint8), np.full((2, 3), u, np.uint8), np.full((2, 3), v, np.uint8)], 8, 9, True, (6, True))
    cb, cr = (u - 127.5) / 127.5, (v - 127.5) / 127.5
    red, blue = y / 255 + 2 * 0.701 * cr, y / 255 + 2 * 0.886 * cb
    green = (y / 255 - 0.299 * red - 0.114 * blue) / 0.587
    assert got[1, 2].tolist() == [round(min(1, max(0, c)) * 255) for c in (red, green, blue)] + [255]
    assert av1.planes_to_rgba([grey, grey, grey], 8, 6, True, (2, True)).tolist() == av1.planes_to_rgba([grey, grey, grey], 8, 6, True).tolist()
    assert av1.apply_alpha(np.array([[[200, 10, 0, 255]]], np.uint8), np.array([[128]], np.uint8)).tolist() == [[[100, 5, 0, 128]]]
