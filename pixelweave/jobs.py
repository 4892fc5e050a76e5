"""Batch jobs over folders of image files. A file is read and decoded once, and goes through its job whole: nothing is shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .operators import arrays, neighbor
from .sources import files

ENCODED = "path string, width int, height int, content binary, error struct<kind:string,message:string>"


def transform(contents: DataFrame, change: Callable[[np.ndarray], np.ndarray], name: str = "Png") -> DataFrame:
    """(path, content) to the changed images, encoded: path, width, height, content; error where a file can't be read."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in ENCODED.split(", ")]
        for frame in frames:
            for path, data in zip(frame["path"], frame["content"], strict=True):  # one image at a time in memory
                row = files.decode_one(path, bytes(data or b""))
                out = {"path": path, "width": None, "height": None, "content": None, "error": row["error"]}
                if row["error"] is None:
                    pixels = change(np.frombuffer(row["pixels"], np.uint8).reshape(row["height"], row["width"], 4))
                    out |= {"width": pixels.shape[1], "height": pixels.shape[0], "content": files.FORMATS[name].encode(pixels)}
                yield pd.DataFrame([out], columns=columns).astype({"width": "Int32", "height": "Int32"})

    return contents.select("path", "content").mapInPandas(run, ENCODED)


def thumbnails_of(contents: DataFrame, most: int) -> DataFrame:
    """Files scaled down to a largest side with the triangle kernel; never scaled up."""
    neighbor.thumbnail_size(1, 1, most)  # refuses sides under 1

    def small(pixels: np.ndarray) -> np.ndarray:
        height, width, _ = pixels.shape
        to = neighbor.thumbnail_size(width, height, most)
        return pixels if to == (width, height) else arrays.resize(pixels, *to, "triangle")

    return transform(contents, small)


def thumbnails(spark: SparkSession, path: str, most: int) -> DataFrame:
    """path, width, height, content (PNG) and error of a folder's files, scaled down."""
    return thumbnails_of(files.scan(spark, path), most)


def blurred_of(contents: DataFrame, sigma: float) -> DataFrame:
    return transform(contents, lambda pixels: arrays.gaussian_blur(pixels, sigma))


def blur_to_table(spark: SparkSession, path: str, out: str, sigma: float) -> DataFrame:
    """Blurs every file and writes the PNG contents to a table; returns path and error (null where it worked)."""
    blurred_of(files.scan(spark, path), sigma).write.mode("overwrite").parquet(out)
    return spark.read.schema(ENCODED).parquet(out).select("path", "error")


def dimensions(spark: SparkSession, path: str) -> DataFrame:
    """path, width, height; nulls for files that can't be read."""
    return files.metadata(files.scan(spark, path)).select("path", "width", "height")
