"""Image files as a stream: new files of a folder are decoded as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.facade import decoded, sniffed

FILE = "path string, modificationTime timestamp, length long, content binary"


def decoded_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Rows of decoded images of new files. Files of no known format are left out before decoding, by native sniffing."""
    files = spark.readStream.format("binaryFile").schema(FILE).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return decoded(files.where(sniffed(F.col("content")).isNotNull()))


def format_counts(spark: SparkSession, folder: str, lateness: str = "1 hour", width: str = "10 minutes") -> DataFrame:
    """Files and bytes of each format in windows of their modification time; late files within ``lateness`` still count."""
    files = spark.readStream.format("binaryFile").schema(FILE).load(folder)
    known = files.select("modificationTime", "length", F.coalesce(sniffed(F.col("content")), F.lit("unknown")).alias("format"))
    grouped = known.withWatermark("modificationTime", lateness).groupBy(F.window("modificationTime", width), "format")
    return grouped.agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
