"""File streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def parquet_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1000, pattern: str = "*.parquet") -> DataFrame:
    """New Parquet files of a folder as a stream; the schema is given, nothing is inferred."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", pattern).parquet(path)
