"""The feed of create, modify, delete and rename events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftline.schema import CHANGE_EVENTS


def read_changes(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: str = CHANGE_EVENTS, max_files: int | None = None
) -> DataFrame:
    """Stream of change events from files that land in ``path``, with a fixed schema."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)
