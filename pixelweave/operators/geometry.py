"""Geometry: predicates and coordinate projections over pixels that carry width and height."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import point


def _check(pixels: DataFrame, ok, message: str) -> DataFrame:
    """Fails the query at the first pixel of an image that doesn't fit."""
    return pixels.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def crop(pixels: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    if width < 1 or height < 1 or x < 0 or y < 0:
        raise ValueError("the crop lies outside the image")
    inside = (F.col("width").cast("bigint") >= x + width) & (F.col("height").cast("bigint") >= y + height)
    kept = _check(pixels, inside, "the crop lies outside the image").where(F.col("x").between(x, x + width - 1) & F.col("y").between(y, y + height - 1))
    return kept.withColumns({"x": (F.col("x") - x).cast("int"), "y": (F.col("y") - y).cast("int"), "width": F.lit(width), "height": F.lit(height)})


def aspect_box(width: int, height: int, aspect_w: int, aspect_h: int) -> tuple[int, int, int, int]:
    """The centred box of an aspect ratio (single precision, rounded half away from zero)."""
    if aspect_w < 1 or aspect_h < 1:
        raise ValueError("the aspect must be positive")
    want, have = np.float32(aspect_w) / np.float32(aspect_h), np.float32(width) / np.float32(height)
    w = width if have <= want else int(np.floor(np.float32(height) * want + np.float32(0.5)))
    h = height if have >= want else int(np.floor(np.float32(width) / want + np.float32(0.5)))
    w, h = max(1, min(w, width)), max(1, min(h, height))
    return (width - w) // 2, (height - h) // 2, w, h


def crop_aspect(pixels: DataFrame, aspect_w: int, aspect_h: int) -> DataFrame:
    """Centre crop, by each image's own size."""
    if aspect_w < 1 or aspect_h < 1:
        raise ValueError("the aspect must be positive")
    f = lambda c: F.col(c).cast("float")
    want = F.lit(float(np.float32(aspect_w) / np.float32(aspect_h))).cast("float")
    have = f("width") / f("height")
    near = lambda v, most: F.greatest(F.lit(1), F.least(F.col(most), F.round(v).cast("int")))
    have = have.cast("float")
    w = F.when(have > want, near((f("height") * want).cast("float"), "width")).otherwise(F.col("width"))
    h = F.when(have < want, near((f("width") / want).cast("float"), "height")).otherwise(F.col("height"))
    boxed = pixels.withColumns({"__w": w, "__h": h}).withColumns({"__x": F.expr("(width - __w) div 2").cast("int"), "__y": F.expr("(height - __h) div 2").cast("int")})
    kept = boxed.where("x >= __x and x < __x + __w and y >= __y and y < __y + __h")
    return kept.withColumns({"x": F.expr("x - __x"), "y": F.expr("y - __y"), "width": F.col("__w"), "height": F.col("__h")}).drop("__w", "__h", "__x", "__y")


def rotate_90(pixels: DataFrame, degrees: int) -> DataFrame:
    turns = {0: ("x", "y"), 90: ("height - 1 - y", "x"), 180: ("width - 1 - x", "height - 1 - y"), 270: ("y", "width - 1 - x")}
    if degrees not in turns:
        raise ValueError("degrees must be 0, 90, 180 or 270")
    x, y = turns[degrees]
    size = ("height", "width") if degrees in (90, 270) else ("width", "height")
    return pixels.withColumns({"x": F.expr(x), "y": F.expr(y), "width": F.col(size[0]), "height": F.col(size[1])})


def flip_horizontal(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("x", F.expr("width - 1 - x"))


def flip_vertical(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("y", F.expr("height - 1 - y"))


def circular_mask(pixels: DataFrame) -> DataFrame:
    """Centre square, then corners of half its side."""
    square = crop_aspect(pixels, 1, 1)
    return point.rounded_corners(square, 1 << 30)
