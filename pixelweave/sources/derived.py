"""Pixel relations: image_id BIGINT, x, y, r, g, b, a INT; and image_dims: image_id, width, height."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _grid(rows: DataFrame, width: int, height: int) -> DataFrame:
    p = F.explode(F.sequence(F.lit(0), F.lit(width * height - 1))).alias("p")
    return rows.select("*", p).withColumn("x", F.col("p") % width).withColumn("y", F.floor(F.col("p") / width).cast("int"))


def solid(spark: SparkSession, width: int, height: int, color: tuple[int, int, int, int]) -> DataFrame:
    """One image of one colour, image_id 0."""
    if width < 1 or height < 1:
        raise ValueError("width and height must be positive")
    p = F.col("id")
    return spark.range(width * height).select(F.lit(0).cast("bigint").alias("image_id"), (p % width).cast("int").alias("x"), F.expr(f"id div {width}").cast("int").alias("y"), *(F.lit(v).alias(c) for c, v in zip("rgba", color, strict=True)))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding is an 8 x 8 image, some pixels transparent."""
    rows = _grid(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("image_id"), "embedding"), 8, 8)
    value = lambda k: F.pmod(F.floor(F.abs(F.col("embedding")[(F.col("p") + k) % 64].cast("float") * F.lit(1000.0).cast("float"))).cast("int"), F.lit(256)).cast("int")
    return rows.select("image_id", "x", "y", value(0).alias("r"), value(1).alias("g"), value(2).alias("b"), F.when((F.col("image_id") + F.col("p")) % 7 == 0, 0).otherwise(255).alias("a"))


def photos(spark: SparkSession, sf_dir: str, table: str = "nation", key: str = "n_nationkey") -> DataFrame:
    """An opaque 64 x 48 pattern for each row of a table."""
    rows = _grid(spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(key).cast("bigint").alias("image_id")), 64, 48)
    x, y = F.col("x"), F.col("y")
    return rows.select("image_id", "x", "y", ((4 * x + 2 * y + F.col("image_id")) % 256).cast("int").alias("r"), ((5 * y + x) % 256).cast("int").alias("g"), F.expr("((x * x + y * y) div 7) % 256").cast("int").alias("b"), F.lit(255).alias("a"))


def dims(pixels: DataFrame) -> DataFrame:
    """Sizes of images that have all their pixels."""
    return pixels.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def fixed_dims(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """The same width and height for every pixel, without a join."""
    return pixels.withColumn("width", F.lit(width)).withColumn("height", F.lit(height))
