"""Result files: CSV with a header, formatted by functions.formats, cells quoted where they hold a comma or a quote."""

from __future__ import annotations

from pyspark.sql import DataFrame

from larkspur.functions.formats import formatted


def unique(names: list[str]) -> list[str]:
    """Repeated names get a number, as a file's header needs."""
    out: list[str] = []
    for name in names:
        k, new = 1, name
        while new in out:
            k += 1
            new = f"{name}_{k}"
        out.append(new)
    return out


def write(df: DataFrame, path: str, one_file: bool = False) -> None:
    """Replaces what is at ``path``. A sorted result keeps its order over the part files' names.

    one_file: a single part file, for small results; its rows pass through one task.
    """
    out = formatted(df).toDF(*unique(df.columns))
    writer = (out.coalesce(1) if one_file else out).write.mode("overwrite")
    writer.option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)
