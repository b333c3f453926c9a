"""Text forms of values in result files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def text(field: T.StructField, col: Column) -> Column:
    """Numbers with two decimals, whole and decimal ones without a detour over doubles; timestamps to the second; NULL as NULL."""
    if isinstance(field.dataType, T.IntegralType):
        return F.concat(col.cast("string"), F.lit(".00"))
    if isinstance(field.dataType, T.DecimalType):
        return F.round(col, 2).cast(T.DecimalType(38, 2)).cast("string")
    if isinstance(field.dataType, T.NumericType):
        return F.when(col.isNotNull(), F.format_string("%.2f", col.cast("double")))
    if isinstance(field.dataType, T.TimestampNTZType | T.TimestampType):
        return F.date_format(col, "yyyy-MM-dd HH:mm:ss")
    return col.cast("string")


def formatted(df: DataFrame) -> DataFrame:
    """Every column as its text; columns are taken by place, as joins may repeat names."""
    names = [f"c{k}" for k in range(len(df.columns))]
    plain = df.toDF(*names)
    return plain.select(*[text(f, F.col(n)) for n, f in zip(names, df.schema, strict=True)]).toDF(*df.columns)
