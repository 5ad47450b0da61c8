"""Compressed files as they arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import jls

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def stream_files(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(SCHEMA).option("maxFilesPerTrigger", per_trigger).load(folder)


def stream_frames(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """Headers of new files; stateless, so any sink and output mode append will do."""
    return jls.read_frames(stream_files(spark, folder, per_trigger))
