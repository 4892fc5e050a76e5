"""Neighbourhood operators in fixed-point integers, so that sums don't depend on their order.

Blur is two window passes over (image, row) and (image, column). Resize joins pixels with a relation of weights, one axis
after the other; the weights of each pair of sizes sum to 65536.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import RGB, RGBA, clamp_int
from . import compose

ONE = 65536


def gaussian_weights(sigma: float) -> list[int]:
    """Weights of the distances 0..radius, the radius being twice sigma."""
    sigma = max(0.1, min(50.0, sigma))
    radius = max(1, math.ceil(2 * sigma))
    raw = [math.exp(-d * d / (2 * sigma * sigma)) for d in range(radius + 1)]
    total = raw[0] + 2 * sum(raw[1:])
    return [int(v / total * ONE + 0.5) for v in raw]


def _pass(pixels: DataFrame, weights: list[int], along: str, across: str, names: tuple[str, ...]) -> DataFrame:
    line = Window.partitionBy("image_id", across).orderBy(along)

    def value(c: str) -> Column:
        total, weight = F.col(c).cast("bigint") * weights[0], F.lit(weights[0]).cast("bigint")
        for d, w in enumerate(weights[1:], 1):
            for tap in (F.lag(c, d).over(line), F.lead(c, d).over(line)):
                total = total + F.coalesce(tap, F.lit(0)) * w
                weight = weight + F.when(tap.isNotNull(), w).otherwise(0)
        return (2 * total + weight), (2 * weight)

    parts = {f"__{k}{c}": v for c in names for k, v in zip("nd", value(c), strict=True)}
    summed = pixels.withColumns(parts)
    return summed.withColumns({c: F.expr(f"__n{c} div __d{c}").cast("int") for c in names}).drop(*parts)


def gaussian_blur(pixels: DataFrame, sigma: float, names: tuple[str, ...] = RGBA) -> DataFrame:
    """Rows first, then columns; weights that fall off the image count for nothing; rounded once per pass."""
    w = gaussian_weights(sigma)
    return _pass(_pass(pixels, w, "x", "y", names), w, "y", "x", names)


def sharpen(pixels: DataFrame, sigma: float, threshold: int) -> DataFrame:
    """Adds the difference to the blurred image where it reaches the threshold."""
    sigma, threshold = max(0.3, min(10.0, sigma)), max(0, min(255, threshold))
    soft = tuple(f"__s{c}" for c in RGB)
    blurred = gaussian_blur(pixels.withColumns({s: F.col(c) for s, c in zip(soft, RGB, strict=True)}), sigma, soft)
    diff = lambda c: F.col(c) - F.col(f"__s{c}")
    return blurred.withColumns({c: F.when(F.abs(diff(c)) >= threshold, clamp_int(F.col(c) + diff(c))).otherwise(F.col(c)) for c in RGB}).drop(*soft)


def _sinc(x: float) -> float:
    return 1.0 if x == 0 else math.sin(math.pi * x) / (math.pi * x)


def _cubic(x: float) -> float:
    x = abs(x)
    return 1.5 * x**3 - 2.5 * x**2 + 1 if x < 1 else (-0.5 * x**3 + 2.5 * x**2 - 4 * x + 2 if x < 2 else 0.0)


#: Support and kernel by name.
KERNELS = {
    "triangle": (1.0, lambda x: max(0.0, 1 - abs(x))),
    "catmull_rom": (2.0, _cubic),
    "gaussian": (3.0, lambda x: math.exp(-2 * x * x)),
    "lanczos3": (3.0, lambda x: _sinc(x) * _sinc(x / 3) if abs(x) < 3 else 0.0),
}


def axis_weights(size: int, out: int, kernel: str) -> list[tuple[int, int, int]]:
    """(output position, input position, weight) with the weights of a position summing to 65536."""
    rows, ratio = [], size / out
    if kernel == "nearest":
        return [(o, min(size - 1, math.floor((o + 0.5) * ratio)), ONE) for o in range(out)]
    support, k = KERNELS[kernel]
    scale = max(1.0, ratio)
    for o in range(out):
        centre = (o + 0.5) * ratio
        taps = [i for i in range(max(0, math.floor(centre - support * scale)), min(size, math.ceil(centre + support * scale) + 1)) if abs(i + 0.5 - centre) < support * scale]
        raw = [k((i + 0.5 - centre) / scale) for i in taps]
        total = sum(raw)
        fixed = [round(v / total * ONE) for v in raw]
        top = max(range(len(fixed)), key=lambda j: (fixed[j], -j))
        fixed[top] += ONE - sum(fixed)
        rows += [(o, i, w) for i, w in zip(taps, fixed, strict=True) if w]
    return rows


def _weights_of(sizes: DataFrame, kernel: str) -> DataFrame:
    """(size, to, o, i, w) for each pair of sizes, made where the sizes are."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a, b in zip(frame["size"], frame["to"], strict=True):
                w = np.array(axis_weights(int(a), int(b), kernel), np.int64).reshape(-1, 3)
                yield pd.DataFrame({"size": a, "to": b, "o": w[:, 0], "i": w[:, 1], "w": w[:, 2]})

    return sizes.distinct().mapInPandas(run, "size int, to int, o int, i int, w bigint")


def _resample(pixels: DataFrame, size: str, along: str, kernel: str) -> DataFrame:
    """One axis of images with the columns to_width and to_height."""
    other = {"x": "y", "y": "x"}[along]
    sizes = pixels.select(F.col(size).alias("size"), F.col(f"to_{size}").alias("to"))
    weights = _weights_of(sizes, kernel).select(F.col("size").alias(size), F.col("to").alias(f"to_{size}"), F.col("i").alias(along), "o", "w")
    keys = ["image_id", other, "to_width", "to_height", *(c for c in ("width", "height") if c != size)]
    sums = pixels.join(weights, [size, f"to_{size}", along]).groupBy(*keys, F.col("o").alias(along)).agg(*(F.sum(F.col(c) * F.col("w")).alias(c) for c in RGBA))
    return sums.withColumns({c: F.expr(f"least(255, (greatest({c}, 0) + {ONE // 2}) div {ONE})").cast("int") for c in RGBA}).withColumn(size, F.col(f"to_{size}"))


def resize(pixels: DataFrame, width: int | Column, height: int | Column, kernel: str = "lanczos3") -> DataFrame:
    """Columns first, then rows, rounded and clamped after each. The new size is the same for all images, or a column's for each; one
    plan whatever the sizes are."""
    if kernel != "nearest" and kernel not in KERNELS:
        raise ValueError(f"unknown kernel {kernel}")
    to = {f"to_{k}": (v if isinstance(v, Column) else F.lit(max(1, v))).cast("int") for k, v in (("width", width), ("height", height))}
    sized = pixels.select("image_id", "x", "y", *RGBA, "width", "height").withColumns(to)
    for size, along in (("height", "y"), ("width", "x")):
        sized = _resample(sized, size, along, kernel)
    return sized.select("image_id", "x", "y", *RGBA, "width", "height")


def thumbnail_size(width: int, height: int, most: int) -> tuple[int, int]:
    if most < 1:
        raise ValueError("the largest side must be positive")
    scale = min(np.float32(most) / np.float32(width), np.float32(most) / np.float32(height))
    if scale >= 1:
        return width, height
    near = lambda v: max(1, int(np.floor(np.float32(v) * scale + np.float32(0.5))))
    return near(width), near(height)


def _scaled(scale: Column) -> tuple[Column, Column]:
    """The sides by a scale, in single precision, rounded and at least 1."""
    side = lambda c: F.greatest(F.lit(1), F.floor((F.col(c).cast("float") * scale).cast("float") + F.lit(0.5).cast("float")).cast("int"))
    return side("width"), side("height")


def _ratio(to: int, side: str) -> Column:
    return (F.lit(to).cast("float") / F.col(side).cast("float")).cast("float")


def thumbnail(pixels: DataFrame, most: int, kernel: str = "lanczos3") -> DataFrame:
    """Images of any sizes, each to its size of at most that side; smaller ones stay as they are."""
    if most < 1:
        raise ValueError("the largest side must be positive")
    width, height = _scaled(F.least(_ratio(most, "width"), _ratio(most, "height")))
    large = (F.col("width") > most) | (F.col("height") > most)
    out = ["image_id", "x", "y", *RGBA, "width", "height"]
    return resize(pixels.where(large), width, height, kernel).unionByName(pixels.where(~large).select(out))


def fit(pixels: DataFrame, width: int, height: int, mode: str) -> DataFrame:
    """Images of any sizes into a box. stretch: resize; fit: centred on transparency; fill: cover, then a centre crop."""
    if mode == "stretch":
        return resize(pixels, width, height)
    if mode not in ("fit", "fill"):
        raise ValueError(f"unknown mode {mode}")
    ratios = _ratio(width, "width"), _ratio(height, "height")
    scaled = resize(pixels, *_scaled(F.least(*ratios) if mode == "fit" else F.greatest(*ratios)))
    if mode == "fill":
        left, top = F.expr(f"(greatest(width, {width}) - {width}) div 2").cast("int"), F.expr(f"(greatest(height, {height}) - {height}) div 2").cast("int")
        moved = scaled.withColumns({"x": F.col("x") - left, "y": F.col("y") - top}).where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))
        return moved.withColumns({"width": F.lit(width), "height": F.lit(height)})
    cells = pixels.select("image_id").distinct().select("image_id", F.explode(F.sequence(F.lit(0), F.lit(width * height - 1))).alias("p"))
    canvas = cells.select("image_id", (F.col("p") % width).cast("int").alias("x"), F.expr(f"p div {width}").cast("int").alias("y"), *(F.lit(0).alias(c) for c in RGBA), F.lit(width).alias("width"), F.lit(height).alias("height"))
    left, top = F.expr(f"({width} - width) div 2").cast("int"), F.expr(f"({height} - height) div 2").cast("int")
    return compose.overlay(canvas, scaled.withColumns({"x": F.col("x") + left, "y": F.col("y") + top}), 0, 0)


def perspective_skew(pixels: DataFrame, skew: float) -> DataFrame:
    """Source x is x - skew * y; linear between two neighbours of the row, in 1/65536; transparent outside; same canvas."""
    shift = int(math.floor(max(-1.0, min(1.0, skew)) * ONE + 0.5))
    at = f"(cast(x as bigint) * {ONE} - {shift} * cast(y as bigint))"
    want = pixels.withColumns({"__at": F.expr(at)}).withColumns({"__i": F.floor(F.col("__at") / ONE).cast("int")})
    want = want.withColumn("__f", F.col("__at") - F.col("__i").cast("bigint") * ONE)
    src = lambda p: pixels.select(F.col("image_id"), F.col("y"), F.col("x").alias("__x" + p), *(F.col(c).alias(p + c) for c in RGBA))
    want = want.withColumn("__j", F.when(F.col("__f") == 0, F.col("__i")).otherwise(F.col("__i") + 1))
    both = want.join(src("p").withColumnRenamed("__xp", "__i"), ["image_id", "y", "__i"], "left").join(src("q").withColumnRenamed("__xq", "__j"), ["image_id", "y", "__j"], "left")
    value = lambda c: F.when(F.col("pa").isNull() | F.col("qa").isNull(), 0).otherwise(F.expr(f"(p{c} * ({ONE} - __f) + q{c} * __f + {ONE // 2}) div {ONE}").cast("int"))
    return both.select(*(value(c).alias(c) if c in RGBA else F.col(c) for c in pixels.columns))


def rotation(degrees: float) -> tuple[int, int]:
    """Cosine and sine in 1/65536."""
    t = math.radians(degrees)
    return math.floor(math.cos(t) * ONE + 0.5), math.floor(math.sin(t) * ONE + 0.5)


def rotate_free(pixels: DataFrame, degrees: float, background: tuple[int, int, int, int] = (0, 0, 0, 0)) -> DataFrame:
    """Clockwise about the centre on the same canvas. Bilinear in fixed point; a pixel with a weighted neighbour outside
    the image is background. Each pixel asks for its (up to four) neighbours in one join and sums them in one group."""
    c, s = rotation(degrees)
    u = f"(2L * x + 1 - width) * {c}L + (2L * y + 1 - height) * {s}L + (width - 1) * {ONE}L"
    v = f"(2L * y + 1 - height) * {c}L - (2L * x + 1 - width) * {s}L + (height - 1) * {ONE}L"
    at = pixels.select("image_id", "x", "y", "width", "height", F.expr(u).alias("u"), F.expr(v).alias("v"))
    at = at.withColumns({"i": F.floor(F.col("u") / (2 * ONE)), "j": F.floor(F.col("v") / (2 * ONE))}).withColumns({"p": F.expr(f"(u - i * {2 * ONE}) div 2"), "q": F.expr(f"(v - j * {2 * ONE}) div 2")})
    taps = F.explode(F.array(*(F.struct((F.col("i") + a).cast("int").alias("x"), (F.col("j") + b).cast("int").alias("y"), F.expr(f"{'p' if a else f'({ONE} - p)'} * {'q' if b else f'({ONE} - q)'}").alias("w")) for a in (0, 1) for b in (0, 1))))
    asked = at.select("image_id", F.col("x").alias("ox"), F.col("y").alias("oy"), "width", "height", taps.alias("t")).where("t.w > 0")
    source = pixels.select("image_id", F.col("x").alias("sx"), F.col("y").alias("sy"), *RGBA)
    joined = asked.join(source.withColumnRenamed("image_id", "si"), (F.col("image_id") == F.col("si")) & (F.col("t.x") == F.col("sx")) & (F.col("t.y") == F.col("sy")), "left")
    half, whole = ONE * ONE // 2, ONE * ONE
    sums = joined.groupBy("image_id", "ox", "oy", "width", "height").agg(F.count_if(F.col("a").isNull()).alias("gone"), *(F.sum(F.col("t.w") * F.col(k)).alias(k) for k in RGBA))
    return sums.select("image_id", F.col("ox").alias("x"), F.col("oy").alias("y"), *(F.when(F.col("gone") > 0, bg).otherwise(F.expr(f"({k} + {half}L) div {whole}L").cast("int")).alias(k) for k, bg in zip(RGBA, background, strict=True)), "width", "height")
