"""A folder of image files as a stream: the file operators are stateless, so they run on it as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources import files

#: Schema of Spark's binary file source.
BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def image_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Decoded images of files as they come in."""
    raw = spark.readStream.format("binaryFile").schema(BINARY).option("maxFilesPerTrigger", files_per_trigger).load(path)
    return files.decode(raw.select("path", "content"))
