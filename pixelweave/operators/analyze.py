"""Analysis: grouped aggregates with partial sums before the shuffle; top-k by window over bucket counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import RGB, channel, f32

#: Pixels with less alpha don't count for colours; bits of a channel that name a bucket; luminance weights.
MIN_ALPHA, BUCKET_SHIFT = 16, 4
REC709 = (0.2126, 0.7152, 0.0722)


def palette(pixels: DataFrame, k: int) -> DataFrame:
    """image_id, rank, r, g, b, n: the k (at least 1) commonest 12-bit colours' means; ties by bucket."""
    keys = [F.shiftright(c, BUCKET_SHIFT).alias(f"k{c}") for c in RGB]
    sums = pixels.where(F.col("a") >= MIN_ALPHA).groupBy("image_id", *keys).agg(F.count("*").alias("n"), *(F.sum(c).alias(f"s{c}") for c in RGB))
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("n"), "kr", "kg", "kb"))
    top = sums.withColumn("rank", rank).where(F.col("rank") <= max(k, 1))
    return top.select("image_id", "rank", *(F.expr(f"s{c} div n").cast("int").alias(c) for c in RGB), "n")


def dominant_color(pixels: DataFrame) -> DataFrame:
    """image_id, r, g, b, a; images without visible pixels have no row."""
    return palette(pixels, 1).select("image_id", *RGB, F.lit(255).alias("a"))


def average_color(pixels: DataFrame) -> DataFrame:
    """Alpha-weighted means, floored; images without alpha have no row."""
    total = F.sum("a")
    sums = pixels.groupBy("image_id").agg(total.alias("t"), *(F.sum(F.col(c).cast("bigint") * F.col("a")).alias(f"s{c}") for c in RGB))
    return sums.where("t > 0").select("image_id", *(F.expr(f"s{c} div t").cast("int").alias(c) for c in RGB), F.lit(255).alias("a"))


def histogram(pixels: DataFrame) -> DataFrame:
    """image_id, channel, bin, n for all 256 bins, over all pixels."""
    long = pixels.select("image_id", F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), F.col(c).alias("bin")) for c in RGB))).alias("e"))
    counts = long.groupBy("image_id", "e.channel", "e.bin").agg(F.count("*").alias("n"))
    filled = counts.groupBy("image_id", "channel").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))  # 256 entries at most
    return filled.select("image_id", "channel", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("bin"), "m").select("image_id", "channel", "bin", F.coalesce(F.try_element_at("m", F.col("bin")), F.lit(0).cast("bigint")).alias("n"))


def luminance(pixels: DataFrame) -> DataFrame:
    """image_id, luminance (0 to 1): weighted sums cut to integers pixel by pixel, then their mean."""
    r, g, b = (f32(w) * channel(c) for c, w in zip(RGB, REC709, strict=True))
    sums = pixels.groupBy("image_id").agg(F.sum((r + g + b).cast("bigint")).alias("s"), F.count("*").alias("n"))
    return sums.select("image_id", ((f32(F.col("s")) / f32(F.col("n"))).cast("float") / f32(255)).cast("float").alias("luminance"))


def brightness_class(pixels: DataFrame) -> DataFrame:
    """is_dark: luminance below 0.4; is_light: 0.6 or more."""
    return luminance(pixels).select("image_id", (F.col("luminance") < f32(0.4)).alias("is_dark"), (F.col("luminance") >= f32(0.6)).alias("is_light"))
