"""A folder of typed CSV files as a stream: each file that arrives is read once, and a query runs over what is new."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from larkspur.sources import typed_csv


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = typed_csv.options(spark.readStream).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.csv(folder)


def run_available(stream: DataFrame, plan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Appends the plan's rows over all files that have arrived since the last call to Parquet, each file exactly once."""
    query = plan(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
