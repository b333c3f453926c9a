"""Folders of tables as temporary views. Files are listed through Hadoop, so any store that Spark reads will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.sources import typed_csv


def listed(spark: SparkSession, folder: str, suffix: str) -> dict[str, str]:
    """Table name to path of all ``*.suffix`` in a folder."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/*.{suffix}")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    paths = sorted(x.getPath().toString() for x in found)
    return {x.rpartition("/")[2][: -len(suffix) - 1]: x for x in paths}


def parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register_csv_folder(spark: SparkSession, folder: str, float32: bool = False) -> dict[str, DataFrame]:
    """A view for each typed CSV, named as its file."""
    tables = {name: typed_csv.read(spark, path, float32) for name, path in listed(spark, folder, "csv").items()}
    for name, df in tables.items():
        df.createOrReplaceTempView(f"`{name}`")
    return tables


def register_parquet_folder(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    tables = {name: spark.read.parquet(path) for name, path in listed(spark, folder, "parquet").items()}
    for name, df in tables.items():
        df.createOrReplaceTempView(f"`{name}`")
    return tables
