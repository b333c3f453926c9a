"""CSV whose header declares types: ``name (N)``, ``name (T)``, ``name (D)``, each optionally with ``(P)`` for a primary key.

N is a number, D a timestamp without zone written ``yyyy-MM-dd HH:mm:ss``, T or no tag a string. Cells that are empty or can't be
read become NULL, short rows are filled with NULL, and white space around cells is dropped. Numbers are doubles; with
``float32`` they are single floats (whole numbers above 2**24 then lose digits).
"""

from __future__ import annotations

import csv
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"


def column(token: str, float32: bool = False) -> T.StructField:
    """The field that one header cell declares."""
    token = token.strip(" \t\r\n\"﻿")
    tags = re.findall(r"\(([^)]*)\)", token)
    tag = tags[0] if tags else ""
    if "N" in tag:
        kind: T.DataType = T.FloatType() if float32 else T.DoubleType()
    elif "D" in tag:
        kind = T.TimestampNTZType()
    else:
        kind = T.StringType()
    return T.StructField(token.partition("(")[0].strip(), kind, True, {"primary_key": "(P)" in token})


def header_schema(line: str, float32: bool = False) -> T.StructType:
    """The schema that a header line declares; names that hold a comma are quoted."""
    return T.StructType([column(x, float32) for x in next(csv.reader([line.lstrip("\ufeff").rstrip("\r\n")], skipinitialspace=True))])


def read_schema(spark: SparkSession, path: str, float32: bool = False) -> T.StructType:
    """Reads one line of the file (or of a folder's first file)."""
    first = spark.read.text(path).first()
    if first is None:
        raise ValueError(f"{path} has no header")
    return header_schema(first[0], float32)


def options(reader):
    return (
        reader.option("header", True)
        .option("mode", "PERMISSIVE")
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .option("timestampNTZFormat", TIMESTAMP_FORMAT)
        .option("enforceSchema", True)
    )


def read(spark: SparkSession, path: str, float32: bool = False, schema: T.StructType | None = None) -> DataFrame:
    return options(spark.read).schema(schema or read_schema(spark, path, float32)).csv(path)


def primary_keys(df: DataFrame) -> list[str]:
    return [x.name for x in df.schema if x.metadata.get("primary_key")]
