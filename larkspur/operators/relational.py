"""The engine's operators over DataFrames. Each only declares a plan; Catalyst and adaptive execution choose how to run it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.shared import cut

#: A side is broadcast by hint only below this many bytes by the optimizer's estimate; beyond it Spark decides.
BROADCAST_BYTES = 64 << 20

COMPARISONS = {
    ">": lambda a, b: a > b,
    "<": lambda a, b: a < b,
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<>": lambda a, b: a != b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
}
AGGREGATES = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "first": F.first}


def project(df: DataFrame, columns: Sequence[str | int | Column], casts: dict[str, str] | None = None, names: Sequence[str] | None = None) -> DataFrame:
    """Columns by name, place or expression, then casts by resulting name; ``names`` are the output's."""
    out = df.select(*[df[df.columns[x]] if isinstance(x, int) else x for x in columns])
    if names:
        out = out.toDF(*names)
    for name, kind in (casts or {}).items():
        out = out.withColumn(name, F.col(name).cast(kind))
    return out


def compare(column: str | Column, op: str, value) -> Column:
    """A comparison by sign; ``value`` is a literal or a column."""
    left = F.col(column) if isinstance(column, str) else column
    return COMPARISONS[op](left, value if isinstance(value, Column) else F.lit(value))


def where(df: DataFrame, *conditions: Column | str) -> DataFrame:
    """Rows for which all conditions hold; unknown (NULL) does not hold."""
    for condition in conditions:
        df = df.where(condition)
    return df


def estimated_bytes(df: DataFrame) -> int:
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """With a broadcast hint if the estimate allows, else as it is."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def kind(of: T.DataType) -> str:
    """What a type's values compare with: numbers with numbers, times with times, else only the same type."""
    if isinstance(of, T.NumericType):
        return "number"
    return "time" if isinstance(of, T.TimestampType | T.TimestampNTZType | T.DateType) else of.simpleString()


def equi_join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], how: str = "inner") -> DataFrame:
    """Join on one or more key pairs (left name, right name); both sides' columns stay. NULL keys match nothing. Keys of
    different kinds are an error, not silently cast."""
    on = None
    for a, b in keys:
        if kind(left.schema[a].dataType) != kind(right.schema[b].dataType):
            raise TypeError(f"join key {a} is a {kind(left.schema[a].dataType)}, {b} a {kind(right.schema[b].dataType)}")
        term = left[a] == right[b]
        on = term if on is None else on & term
    return left.join(right, on, how)


def theta_join(left: DataFrame, right: DataFrame, condition: Column, how: str = "inner") -> DataFrame:
    """Join on any condition; equalities in it are used as keys."""
    return left.join(right, condition, how)


def scalar_compare(df: DataFrame, column: str, op: str, scalar: DataFrame) -> DataFrame:
    """Rows whose column compares with the one value of ``scalar`` (one row, one column) by a scalar subquery."""
    return df.where(compare(column, op, scalar.scalar()))


def first_row(df: DataFrame, *order: Column | str) -> DataFrame:
    """One row of many, the first by ``order``: what a scalar subquery over several rows may use."""
    return (df.orderBy(*order) if order else df).limit(1)


def aggregate(df: DataFrame, *calls: tuple[str, str, str]) -> DataFrame:
    """Whole-table aggregates (function, column or ``*``, output name): one row, also for no input."""
    return df.agg(*[(F.count(F.lit(1)) if (f, c) == ("count", "*") else AGGREGATES[f](c)).alias(name) for f, c, name in calls])


def order_by(df: DataFrame, *keys: tuple[str, str] | str) -> DataFrame:
    """Global sort by (column, "asc" or "desc") or column; NULL always last."""
    pairs = [(k, "asc") if isinstance(k, str) else k for k in keys]
    return df.orderBy(*[F.col(c).desc_nulls_last() if way.lower() == "desc" else F.col(c).asc_nulls_last() for c, way in pairs])


def ranked(df: DataFrame, *keys: tuple[str, str] | str, name: str = "position") -> DataFrame:
    """The global sort with each row's place in it, from 1. The sort's ranges stay where they are: a row's place is its place in its range
    plus the counts of the ranges before, one row a range, so no task sees more than a range."""
    placed = cut(order_by(df, *keys).withColumn("_at", F.monotonically_increasing_id()))  # the range, and 33 bits of the place in it
    counts = placed.groupBy(F.shiftright("_at", 33).alias("_range")).count()
    total = counts.agg(F.sort_array(F.collect_list(F.struct("_range", "count"))).alias("all"))
    ahead = total.select(F.posexplode("all").alias("k", "own"), "all").select(F.col("own._range").alias("_range"), F.aggregate(F.slice("all", 1, F.col("k")), F.lit(0).cast("long"), lambda n, x: n + x["count"]).alias("_ahead"))
    joined = placed.withColumn("_range", F.shiftright("_at", 33)).join(F.broadcast(ahead), "_range")  # a row for each range
    return joined.select(*df.columns, (F.col("_ahead") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).alias(name))
