"""Files as a stream: the same stateless stages, with re-deliveries dropped inside a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parchment.sources.decode import decode


def text_stream(spark: SparkSession, folder: str, delay: str = "1 hour") -> DataFrame:
    """path, text, error of files as they arrive in ``folder``."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", "true").load(folder)
    return decode(files.withWatermark("modificationTime", delay).dropDuplicatesWithinWatermark(["path", "length"]))
