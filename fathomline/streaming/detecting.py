"""Format detection over a stream of files, and an incremental scan by what a stream has already seen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fathomline.operators.detect import detect


def file_stream(spark: SparkSession, path: str, pattern: str = "*", files_per_batch: int = 1000) -> DataFrame:
    """New non-empty files under a directory: path, modificationTime, length and content."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).load(path)


def detected_stream(files: DataFrame, lateness: str = "7 days") -> DataFrame:
    """path, length, format and confidence of each file once: a path that comes again with one time and length within the lateness is passed over."""
    unseen = files.withWatermark("modificationTime", lateness).dropDuplicatesWithinWatermark(["path", "modificationTime", "length"])
    return detect(unseen.select("path", "modificationTime", "length", "content")).drop("content")
