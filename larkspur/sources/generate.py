"""Random typed CSV tables with primary and foreign keys, made by Spark, equal for equal seeds.

Each table has ``id (N) (P)``, further columns of random kinds, and for every earlier table that it refers to a column with ids of it.
"""

from __future__ import annotations

import random
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.sources.typed_csv import TIMESTAMP_FORMAT

NOUNS = ("amount", "city", "code", "day", "grade", "label", "level", "moment", "price", "title", "weight", "zone")


@dataclass
class TablePlan:
    name: str
    rows: int
    columns: list[tuple[str, str]]  # (name, "N", "T" or "D")
    refers_to: list[str] = field(default_factory=list)


def plans(tables: int = 2, rows: int = 1000, seed: int = 42) -> list[TablePlan]:
    """What a seed gives: 3 or 4 columns a table, each table referring to at most two earlier ones."""
    rng, out = random.Random(seed), []
    for k in range(tables):
        names = rng.sample(NOUNS, rng.randint(3, 4))
        earlier = [x.name for x in out]
        out.append(TablePlan(f"table_{k + 1}", rows, [(x, rng.choice("NTD")) for x in names], rng.sample(earlier, min(len(earlier), rng.randint(0, 2)))))
    return out


def _value(kind: str, seed: int, rows: int) -> Column:
    if kind == "N":
        return F.round(F.rand(seed) * rows, 2).cast("decimal(20,2)").cast("string")
    if kind == "T":
        return F.substring(F.md5(F.rand(seed).cast("string")), 1, 12)
    return F.date_format(F.timestamp_seconds(F.lit(946_684_800) + F.floor(F.rand(seed) * 788_000_000)), TIMESTAMP_FORMAT)


def table(spark: SparkSession, plan: TablePlan, sizes: dict[str, int], seed: int = 42, missing: float = 0.05) -> DataFrame:
    """The plan's rows as text, with the header's names; ``missing``: the share of empty cells outside of keys."""
    out = [(F.col("id") + 1).cast("string").alias("id (N) (P)")]
    for k, (name, kind) in enumerate(plan.columns):
        at = seed * 1000 + 2 * k
        out.append(F.when(F.rand(at + 1) >= missing, _value(kind, at, plan.rows)).alias(f"{name} ({kind})"))
    for k, other in enumerate(plan.refers_to):
        out.append((F.floor(F.rand(seed * 1000 + 500 + k) * sizes[other]) + 1).cast("string").alias(f"{other}_id (N)"))
    return spark.range(plan.rows).select(*out)


def write(spark: SparkSession, folder: str, wanted: list[TablePlan], seed: int = 42) -> None:
    """Each table as ``folder/name.csv``, in as many part files as there are partitions, each with the header."""
    sizes = {x.name: x.rows for x in wanted}
    for k, plan in enumerate(wanted):
        table(spark, plan, sizes, seed + k).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(f"{folder}/{plan.name}.csv")
