"""Point filters: one projection each; Catalyst merges chains of them into one. Alpha is kept unless a filter says so."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import RGB, RGBA, channel, clamp255, clamp_int, f32, luma, rounded


def _set(pixels: DataFrame, values: dict[str, Column]) -> DataFrame:
    return pixels.withColumns(values)


def _limit(value: float, low: float, high: float) -> float:
    return max(low, min(high, value))


def brightness(pixels: DataFrame, amount: int) -> DataFrame:
    v = int(_limit(amount, -255, 255))
    return _set(pixels, {c: clamp_int(F.col(c) + v) for c in RGB})


def contrast(pixels: DataFrame, factor: float) -> DataFrame:
    k = f32(max(0.0, factor))
    return _set(pixels, {c: rounded((channel(c) - f32(128)) * k + f32(128)) for c in RGB})


def saturate(pixels: DataFrame, factor: float) -> DataFrame:
    k, grey = f32(max(0.0, factor)), luma()
    return _set(pixels, {c: rounded(grey + (channel(c) - grey) * k) for c in RGB})


def white_balance(pixels: DataFrame, temperature: float) -> DataFrame:
    shift = f32(float(np.float32(_limit(temperature, -100, 100)) / np.float32(100) * np.float32(30)))
    return _set(pixels, {"r": rounded(channel("r") + shift), "b": rounded(channel("b") - shift)})


def grayscale(pixels: DataFrame) -> DataFrame:
    """Integer luma; alpha becomes 255."""
    grey = F.expr("(2126 * r + 7152 * g + 722 * b) div 10000").cast("int")
    return _set(pixels, {**dict.fromkeys(RGB, grey), "a": F.lit(255)})


#: Rows of the sepia matrix.
SEPIA = {"r": (0.393, 0.769, 0.189), "g": (0.349, 0.686, 0.168), "b": (0.272, 0.534, 0.131)}


def sepia(pixels: DataFrame) -> DataFrame:
    return _set(pixels, {c: rounded(luma(w)) for c, w in SEPIA.items()})


def invert(pixels: DataFrame) -> DataFrame:
    return _set(pixels, {c: (255 - F.col(c)).cast("int") for c in RGB})


def hue_matrix(degrees: int) -> dict[str, tuple[float, float, float]]:
    """Fixed coefficients of the public hue-rotation matrix, in double precision."""
    t = math.radians(_limit(degrees, -180, 180))
    c, s = math.cos(t), math.sin(t)
    return {
        "r": (0.213 + 0.787 * c - 0.213 * s, 0.715 - 0.715 * c - 0.715 * s, 0.072 - 0.072 * c + 0.928 * s),
        "g": (0.213 - 0.213 * c + 0.143 * s, 0.715 + 0.285 * c + 0.140 * s, 0.072 - 0.072 * c - 0.283 * s),
        "b": (0.213 - 0.213 * c - 0.787 * s, 0.715 - 0.715 * c + 0.715 * s, 0.072 + 0.928 * c + 0.072 * s),
    }


def hue_rotate(pixels: DataFrame, degrees: int) -> DataFrame:
    total = lambda w: sum((F.col(c).cast("double") * F.lit(k) for c, k in zip(RGB[1:], w[1:], strict=True)), F.col("r").cast("double") * F.lit(w[0]))
    return _set(pixels, {c: F.greatest(F.lit(0.0), F.least(F.lit(255.0), total(w))).cast("int") for c, w in hue_matrix(degrees).items()})


def tint(pixels: DataFrame, color: tuple[int, int, int, int]) -> DataFrame:
    """Multiplies all four channels by the colour."""
    return _set(pixels, {c: F.expr(f"({c} * {int(t)}) div 255").cast("int") for c, t in zip(RGBA, color, strict=True)})


def convert_colorspace(pixels: DataFrame, space: str) -> DataFrame:
    """srgb: as it is; grayscale; display_p3: a gamma table of 256 entries, then more saturation."""
    if space == "srgb":
        return pixels
    if space == "grayscale":
        return grayscale(pixels)
    if space != "display_p3":
        raise ValueError(f"unknown colour space {space}")
    table = F.array(*(F.lit(v) for v in gamma_table()))
    return saturate(_set(pixels, {c: table[F.col(c)] for c in RGB}), 1.08)


def gamma_table(gamma: float = 1.1) -> list[int]:
    one = np.float32(255)
    power = np.power(np.arange(256, dtype=np.float32) / one, np.float32(1) / np.float32(gamma), dtype=np.float32)
    return [int(v) for v in np.floor(power * one + np.float32(0.5))]


def rounded_corners(pixels: DataFrame, radius: int) -> DataFrame:
    """pixels with width and height. Alpha is 0 beyond the corners' circles; the radius is at most half of a side."""
    r = F.least(F.lit(int(radius)), F.expr("width div 2"), F.expr("height div 2"))
    off = lambda p, n: F.greatest(r - 1 - F.col(p), F.col(p) - (F.col(n) - r), F.lit(0))
    dx, dy = off("x", "width"), off("y", "height")
    out = (dx > 0) & (dy > 0) & (dx * dx + dy * dy > r * r)
    return _set(pixels, {"a": F.when(out, 0).otherwise(F.col("a"))})
