"""AV1's arithmetic-coded symbols, their adaptive distributions, and the colours of decoded planes.

The default distributions of the standard are some thousands of numbers; they are no part of this package but a parameter: the text
of the standard's listings (``Default_..._Cdf[ 4 ][ 14 ] = { ... }``), as ``listing.listing`` reads them.
"""

from __future__ import annotations

import numpy as np

from . import CodecError, damaged

#: Bits of a probability, bits of it that a product keeps, least share of the range that a symbol has.
BITS, KEPT, LEAST = 15, 9, 4
#: Quantizer indices up to which the first, second and third set of coefficient distributions hold.
QUANTIZERS = (20, 60, 120)


class Symbols:
    """Symbols of one tile. The standard's value is the coded bits, inverted; those after the end are read as zeros."""

    def __init__(self, data: bytes, adapt: bool = True) -> None:
        self.data, self.adapt = data, adapt
        self.size = 8 * len(data)
        self.at, self.range = 0, 1 << BITS
        self.value = self._take(BITS)

    def _take(self, n: int) -> int:
        """The next n bits, inverted."""
        first, self.at = self.at, self.at + n
        raw = int.from_bytes(self.data[first >> 3 : (self.at + 7) >> 3].ljust((self.at + 7 >> 3) - (first >> 3), b"\0"))
        return ~(raw >> (-self.at & 7)) & ((1 << n) - 1)

    def _choose(self, cdf) -> int:
        """The symbol whose part of the range has the value; the range becomes that part."""
        n = len(cdf) - 1
        above = self.range
        for symbol in range(n):
            share = ((self.range >> 8) * ((1 << BITS) - int(cdf[symbol]) >> BITS - KEPT) >> KEPT - 8) + LEAST * (n - 1 - symbol)
            if self.value >= share:
                break
            above = share
        else:
            raise damaged("a distribution doesn't end")
        self.value, self.range = self.value - share, above - share
        if missing := BITS + 1 - self.range.bit_length():
            self.range <<= missing
            self.value = self.value << missing | self._take(missing)
        return symbol

    def symbol(self, cdf: np.ndarray) -> int:
        """A symbol; its distribution (cumulative shares of 32768, then how often it was used) moves towards it."""
        found = self._choose(cdf)
        if self.adapt:
            n = len(cdf) - 1
            used = int(cdf[n])
            rate = 3 + (used > 15) + (used > 31) + min(n.bit_length() - 1, 2)
            own = cdf[: n - 1].astype(np.int32)
            up = np.arange(n - 1) >= found
            cdf[: n - 1] = np.where(up, own + ((1 << BITS) - own >> rate), own - (own >> rate))
            cdf[n] = min(used + 1, 32)
        return found

    def literal(self, n: int) -> int:
        """n bits that are as likely one as zero, the highest first."""
        out = 0
        for _ in range(n):
            out = out << 1 | self._choose((1 << BITS - 1, 1 << BITS, 0))
        return out

    def below(self, n: int) -> int:
        """A number under n, of one bit less where that tells it."""
        if n <= 1:
            return 0
        width = n.bit_length()
        short = (1 << width) - n
        value = self.literal(width - 1)
        return value if value < short else (value << 1) - short + self.literal(1)

    def finish(self) -> None:
        """Checks the end: after the bits that decided something a one, then zeros."""
        left = self.size - self.at
        if left < 1 - BITS:
            raise damaged("a tile has too few bits")
        one = self.at - min(BITS, left + BITS)
        rest = int.from_bytes(self.data) & ((1 << self.size - one) - 1)
        if rest != 1 << self.size - one - 1:
            raise damaged("a tile doesn't end in a one and zeros")


class Distributions:
    """A tile's own copy of the distributions, by the standard's names. Those of coefficients (which have a first axis of the quantizer
    sets) are taken for a quantizer index."""

    COEFFICIENTS = ("Default_Txb_Skip_Cdf", "Default_Eob_Pt_16_Cdf", "Default_Eob_Pt_32_Cdf", "Default_Eob_Pt_64_Cdf", "Default_Eob_Pt_128_Cdf", "Default_Eob_Pt_256_Cdf", "Default_Eob_Pt_512_Cdf", "Default_Eob_Pt_1024_Cdf", "Default_Eob_Extra_Cdf", "Default_Dc_Sign_Cdf", "Default_Coeff_Base_Eob_Cdf", "Default_Coeff_Base_Cdf", "Default_Coeff_Br_Cdf")

    def __init__(self, tables: dict[str, np.ndarray], quantizer: int = 0) -> None:
        for name, table in tables.items():
            flat = table.reshape(-1, table.shape[-1])
            if (flat[:, -2] != 1 << BITS).any() or (np.diff(flat[:, :-1], axis=1) < 0).any():
                raise CodecError("invalid_input", f"{name} has no cumulative shares of {1 << BITS}")
        self.tables = tables
        self.own = {name: table.copy() for name, table in tables.items() if name not in self.COEFFICIENTS}
        self.coefficients(quantizer)

    def coefficients(self, quantizer: int) -> None:
        """Starts the coefficients' distributions anew, for a quantizer index."""
        which = sum(quantizer > q for q in QUANTIZERS)
        self.own.update({name: self.tables[name][which].copy() for name in self.COEFFICIENTS if name in self.tables})

    def __getitem__(self, place) -> np.ndarray:
        """One distribution by name and contexts, to be changed in place."""
        name, *contexts = place if isinstance(place, tuple) else (place,)
        found = self.own[name][tuple(contexts)]
        if found.ndim != 1:
            raise KeyError(f"{name} needs more contexts")
        return found


#: Shares of red and blue in the luma by matrix number; all others as BT.709.
LUMA_SHARES = {1: (0.2126, 0.0722), 2: (0.301, 0.114), 4: (0.299, 0.114), 5: (0.299, 0.114), 6: (0.299, 0.114), 7: (0.299, 0.114), 9: (0.2627, 0.0593)}
UNSPECIFIED = 2


def planes_to_rgba(planes: list[np.ndarray], depth: int, matrix: int, full: bool, colour: tuple[int, bool] | None = None) -> np.ndarray:
    """One plane (grey) or three (luma and two chroma planes of any size) to RGBA. colour: the container's matrix and range, which win
    over the stream's. Chroma is the nearest sample's."""
    if colour is not None:
        matrix, full = (matrix if colour[0] == UNSPECIFIED else colour[0]), colour[1]
    top = float((1 << depth) - 1)
    height, width = planes[0].shape
    luma = planes[0].astype(np.float64)
    luma = luma / top if full else (luma - 16 / 255 * top) / (224 / 255 * top)
    if len(planes) >= 3 and planes[1].size:
        rows = np.minimum(np.arange(height) * planes[1].shape[0] // height, planes[1].shape[0] - 1)
        columns = np.minimum(np.arange(width) * planes[1].shape[1] // width, planes[1].shape[1] - 1)
        reach = top / 2 if full else top * 0.5 / 255 * 224 / 255
        u, v = ((p[rows][:, columns].astype(np.float64) - top / 2) / reach for p in planes[1:3])
        red, blue = LUMA_SHARES.get(matrix, LUMA_SHARES[1])
        green = 1 - red - blue
        colours = [luma + 2 * (1 - red) * v, luma - 2 * (1 - red) * red / green * v - 2 * (1 - blue) * blue / green * u, luma + 2 * (1 - blue) * u]
    else:
        colours = [luma] * 3
    values = np.stack(colours, axis=2) * (255 if full else 224) + (0 if full else 16)
    out = np.full((height, width, 4), 255, np.uint8)
    out[..., :3] = np.clip(np.sign(values) * np.floor(np.abs(values) + 0.5), 0, 255)
    return out


def apply_alpha(rgba: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """Colours times an alpha plane of 8 bits and the same size, rounded, and the plane as their alpha."""
    out = rgba.copy()
    a = alpha.astype(np.uint32)
    out[..., :3] = (rgba[..., :3] * a[..., None] + 127) // 255
    out[..., 3] = alpha
    return out
