"""Compositing: equi-joins on pixel coordinates. Spark chooses broadcast or shuffle by the layer's measured size."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fonts
from ..functions.expr import RGB, RGBA, channel, f32, luma, rounded

MODES = ("normal", "multiply", "screen", "overlay", "add")


def _beside(base: DataFrame, top: DataFrame, x: int, y: int) -> DataFrame:
    """base with the columns tr, tg, tb, ta of the layer, shifted; null where it doesn't reach. A layer without image_id
    goes on every image."""
    layer = top.select(*(["image_id"] if "image_id" in top.columns else []), (F.col("x") + x).alias("x"), (F.col("y") + y).alias("y"), *(F.col(c).alias(f"t{c}") for c in RGBA))
    return base.join(layer, [c for c in ("image_id", "x", "y") if c in layer.columns], "left")


def _out(joined: DataFrame, base: DataFrame, values: dict[str, Column]) -> DataFrame:
    return joined.select(*(values.get(c, F.col(c)).alias(c) for c in base.columns))


def overlay(base: DataFrame, top: DataFrame, x: int, y: int) -> DataFrame:
    """Source-over in single precision; cut, not rounded."""
    joined = _beside(base, top, x, y)
    af, ab = f32(F.col("ta")) / f32(255), f32(F.col("a")) / f32(255)
    af, ab = af.cast("float"), ab.cast("float")
    alpha = ab + af - ab * af
    mixed = lambda c: (((f32(F.col(f"t{c}")) / f32(255)).cast("float") * af + (channel(c) / f32(255)).cast("float") * ab * (f32(1) - af)) / alpha).cast("float")
    pick = lambda c, v: F.when(F.col("ta").isNull() | (F.col("ta") == 0), F.col(c)).when((F.col("ta") == 255) | (F.col("a") == 0), F.col(f"t{c}")).otherwise((v * f32(255)).cast("int"))
    return _out(joined, base, {**{c: pick(c, mixed(c)) for c in RGB}, "a": pick("a", alpha)})


def blend_value(mode: str, b: Column, t: Column) -> Column:
    """The blended channel in 0..255 of base and top channels in 0..1, before the opacity."""
    one, two = f32(1), f32(2)
    if mode not in MODES:
        raise ValueError(f"unknown blend mode {mode}")
    value = {"normal": t, "multiply": b * t, "screen": one - (one - b) * (one - t), "overlay": F.when(b < f32(0.5), two * b * t).otherwise(one - two * (one - b) * (one - t)), "add": F.least(b + t, one)}[mode]
    return rounded(value * f32(255))


def blend(base: DataFrame, top: DataFrame, mode: str, opacity: float, x: int = 0, y: int = 0) -> DataFrame:
    """Alpha changes in mode normal only."""
    joined = _beside(base, top, x, y)
    strength = ((f32(F.col("ta")) / f32(255)).cast("float") * f32(max(0.0, min(1.0, opacity)))).cast("float")
    unit = lambda name: (f32(F.col(name)) / f32(255)).cast("float")
    new = {c: F.when(F.col("ta").isNull(), F.col(c)).otherwise(rounded(channel(c) * (f32(1) - strength) + f32(blend_value(mode, unit(c), unit(f"t{c}"))) * strength)) for c in RGB}
    if mode == "normal":
        under = unit("a")
        new["a"] = F.when(F.col("ta").isNull(), F.col("a")).otherwise(rounded((under + strength * (f32(1) - under)) * f32(255)))
    return _out(joined, base, new)


def alpha_mask(base: DataFrame, mask: DataFrame) -> DataFrame:
    """Alpha times the rounded luma of the mask, which has the same size."""
    grey = mask.select("image_id", "x", "y", rounded(luma()).alias("m"))
    return _out(base.join(grey, ["image_id", "x", "y"]), base, {"a": F.expr("(a * m) div 255").cast("int")})


def watermark_bar(pixels: DataFrame, text: str, x: int, y: int, size: float, color: tuple[int, int, int, int]) -> DataFrame:
    """The bar that stands for a text where no font is at hand: a rectangle as wide as the text about would be."""
    if not text:
        raise ValueError("the text is empty")
    size = max(6.0, size)
    w, h = math.floor(len(text) * size * 0.6 + 0.5), math.floor(size * 0.5 + 0.5)
    alpha = f32(color[3]) / f32(255) * f32(0.85)
    alpha = alpha.cast("float")
    inside = F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1)
    return pixels.withColumns({c: F.when(inside, rounded(channel(c) * (f32(1) - alpha) + f32(v) * alpha)).otherwise(F.col(c)) for c, v in zip(RGB, color[:3], strict=True)})


def watermark_text(pixels: DataFrame, text: str, x: int, y: int, size: float, color: tuple[int, int, int, int], family: str = fonts.STAND_IN, folders: Iterable[str] = fonts.FOLDERS) -> DataFrame:
    """A text by a font of that family (or the one that stands in), else the bar. The text's pixels, a few thousand rows however many
    images there are, are broadcast. Glyphs are blended one after the other, rounded after each."""
    if not text:
        raise ValueError("the text is empty")
    if (font := fonts.find(family, folders)) is None:
        return watermark_bar(pixels, text, x, y, size, color)
    shares: dict[tuple[int, int], list[float]] = {}
    for _, px, py, share in fonts.text_coverage(font, text, x, y, max(6.0, size)):
        if px >= 0 and py >= 0:
            shares.setdefault((px, py), []).append(share)
    mask = pixels.sparkSession.createDataFrame([(px, py, own) for (px, py), own in shares.items()], "x int, y int, shares array<float>")
    one, full = f32(1), f32(255)

    def glyph(under: Column, share: Column) -> Column:
        alpha = (share * f32(color[3]) / full).cast("float")
        top = [rounded(channel_of(under[c]) * (one - alpha) + f32(v) * alpha).alias(c) for c, v in zip(RGB, color[:3], strict=True)]
        old = (channel_of(under["a"]) / full).cast("float")
        return F.struct(*top, rounded((old + alpha * (one - old)) * full).alias("a"))

    channel_of = lambda c: c.cast("float")
    start = F.struct(*(F.col(c).cast("int").alias(c) for c in RGBA))
    joined = pixels.join(F.broadcast(mask), ["x", "y"], "left").withColumn("shares", F.aggregate(F.coalesce("shares", F.array().cast("array<float>")), start, glyph))
    return joined.select(*(F.col("shares")[c].alias(c) if c in RGBA else F.col(c) for c in pixels.columns))
