"""Tables of arriving files: the readers over a stream of binaryFile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import Limits
from tessera.operators.pixels import magic
from tessera.sources import readers


def arriving(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Stream of files with their format, as they appear in a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)
    return stream.withColumn("format", magic(F.col("content")))


def arriving_frames(spark: SparkSession, path: str, limits: Limits = Limits(), files_per_batch: int = 100) -> DataFrame:
    return readers.frames(arriving(spark, path, files_per_batch).where("format = 'gif'"), limits)


def arriving_pages(spark: SparkSession, path: str, limits: Limits = Limits(), files_per_batch: int = 100) -> DataFrame:
    return readers.pages(arriving(spark, path, files_per_batch).where("format = 'tiff'"), limits)


def arriving_bitmaps(spark: SparkSession, path: str, limits: Limits = Limits(), files_per_batch: int = 100) -> DataFrame:
    return readers.bmp(arriving(spark, path, files_per_batch).where("format = 'bmp'"), limits)
