"""Runs SQL texts and files over a folder of tables, with plans, timings and result files."""

from __future__ import annotations

import csv
import json
import re
import time
from collections.abc import Iterator
from contextlib import contextmanager, redirect_stdout
from io import StringIO
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from larkspur.plans import dialect
from larkspur.sources import catalog, result_csv


class Profiler:
    """Wall milliseconds of named steps."""

    def __init__(self):
        self.steps: list[tuple[str, float]] = []

    @contextmanager
    def step(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.steps.append((name, (time.perf_counter() - began) * 1000))

    def write(self, path: str) -> None:
        with open(path, "w", newline="") as out:
            rows = csv.writer(out)
            rows.writerow(["Operation", "Time_ms"])
            rows.writerows((name, f"{ms:.3f}") for name, ms in self.steps)


def statement(text: str) -> str:
    """The one statement of a query file, without the closing semicolon."""
    return text.strip().rstrip(";").strip()


def _kind(of: str) -> str:
    """What values of a type, by its name in a plan, compare with."""
    if re.match(r"byte|short|integer|long|float|double|decimal", of):
        return "number"
    return "time" if re.match(r"timestamp|date", of) else of


def mixed_keys(df: DataFrame) -> list[str]:
    """Equalities of two columns of different kinds in a plan's joins and filters, which Spark would cast."""
    out: list[str] = []

    def read(nodes: list[dict], at: int) -> tuple[dict | None, int]:
        """The column that the expression at a place is, without casts around it; and where the next expression begins."""
        node, at = nodes[at], at + 1
        sides = []
        for _ in range(node["num-children"]):
            side, at = read(nodes, at)
            sides.append(side)
        name = node["class"].rpartition(".")[2]
        if name == "EqualTo" and all(sides):
            kinds = [_kind(x["dataType"]) for x in sides]
            if kinds[0] != kinds[1]:
                out.append(" = ".join(f"{x['name']} ({k})" for x, k in zip(sides, kinds, strict=True)))
        return node if name == "AttributeReference" else sides[0] if name == "Cast" else None, at

    for node in json.loads(df._jdf.queryExecution().analyzed().toJSON()):
        if node.get("condition"):
            read(node["condition"], 0)
    return out


class Engine:
    def __init__(self, spark: SparkSession):
        self.spark, self.profiler = spark, Profiler()

    def load(self, folder: str, float32: bool = False) -> list[str]:
        """Registers the typed CSVs and Parquet tables of a folder; their names."""
        with self.profiler.step("load"):
            return [*catalog.register_csv_folder(self.spark, folder, float32), *catalog.register_parquet_folder(self.spark, folder)]

    def sql(self, text: str, first_row: bool = False) -> DataFrame:
        """first_row: scalar subqueries of several rows give their first one. Columns of different kinds are no join keys."""
        with self.profiler.step("plan"):
            text = dialect.nulls_last(statement(text))
            df = self.spark.sql(dialect.first_row_scalars(text) if first_row else text)
            if mixed := mixed_keys(df):
                raise TypeError(f"keys of different kinds: {', '.join(mixed)}")
            return df

    def sql_file(self, path: str, first_row: bool = False) -> DataFrame:
        return self.sql(Path(path).read_text(encoding="utf-8"), first_row)

    def explain(self, df: DataFrame, mode: str = "formatted") -> str:
        with redirect_stdout(StringIO()) as out:
            df.explain(mode)
        return out.getvalue()

    def write(self, df: DataFrame, path: str, one_file: bool = False) -> None:
        with self.profiler.step("run"):
            result_csv.write(df, path, one_file)
