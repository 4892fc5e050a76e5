"""Channel arithmetic as Catalyst expressions: single precision, half away from zero, saturation to 0..255."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RGB, RGBA = ("r", "g", "b"), ("r", "g", "b", "a")
#: Weights of red, green and blue in luma.
LUMA = (0.299, 0.587, 0.114)


def f32(value: float | Column) -> Column:
    """Every operand and literal is a FLOAT; Spark would make FLOAT * INT a DOUBLE."""
    return (value if isinstance(value, Column) else F.lit(float(value))).cast("float")


def channel(name: str) -> Column:
    return f32(F.col(name))


def clamp255(value: Column) -> Column:
    """To 0..255, as an INT (what is left of the point is cut)."""
    low, high = (f32(0.0), f32(255.0))
    return F.greatest(low, F.least(high, value)).cast("int")


def rounded(value: Column) -> Column:
    """Half up after saturation, in double precision where the half is exact; Spark's round() goes through decimals."""
    held = F.greatest(f32(0.0), F.least(f32(255.0), value)).cast("double")
    return F.floor(held + F.lit(0.5)).cast("int")


def clamp_int(value: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), value)).cast("int")


def luma(weights: tuple[float, float, float] = LUMA) -> Column:
    r, g, b = (channel(c) * f32(w) for c, w in zip(RGB, weights, strict=True))
    return r + g + b


def hex_color(text: Column) -> Column:
    """Struct r, g, b, a of a hex colour: any number of leading #, then 6 or 8 digits; else null."""
    digits = F.regexp_replace(text, "^#+", "")
    pair = lambda i: F.conv(F.substring(digits, i, 2), 16, 10).cast("int")
    ok = digits.rlike("^([0-9a-fA-F]{6}|[0-9a-fA-F]{8})$")
    alpha = F.when(F.length(digits) == 8, pair(7)).otherwise(255)
    return F.when(ok, F.struct(pair(1).alias("r"), pair(3).alias("g"), pair(5).alias("b"), alpha.cast("int").alias("a")))
