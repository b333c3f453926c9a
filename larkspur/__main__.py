"""python -m larkspur DATA_FOLDER QUERY [--out FOLDER] [--explain] [--profile FILE] [--float32] [--one-file] [--first-row]

QUERY is a file with one SQL statement, or a folder of such files (*.txt, *.sql), which run in the order of their names.
"""

from __future__ import annotations

import argparse
from pathlib import Path

from larkspur.plans.engine import Engine
from larkspur.session import session


def query_files(path: str) -> list[Path]:
    found = Path(path)
    return sorted(x for x in found.iterdir() if x.suffix in (".txt", ".sql")) if found.is_dir() else [found]


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="larkspur", description="Run SQL files over a folder of tables.")
    parser.add_argument("data")
    parser.add_argument("query", help="a file, or a folder of files")
    parser.add_argument("--out", help="folder for the results, one below it for each query of a folder; without it the first rows are printed")
    parser.add_argument("--one-file", action="store_true")
    parser.add_argument("--explain", action="store_true")
    parser.add_argument("--profile", help="file for the timings")
    parser.add_argument("--float32", action="store_true")
    parser.add_argument("--first-row", action="store_true", help="scalar subqueries of several rows give their first one")
    told = parser.parse_args(args)
    engine = Engine(session())
    engine.load(told.data, told.float32)
    files = query_files(told.query)
    for file in files:
        with engine.profiler.step(file.stem):
            df = engine.sql_file(str(file), told.first_row)
            if told.explain:
                print(engine.explain(df))
            if told.out:
                engine.write(df, told.out if len(files) == 1 else f"{told.out}/{file.stem}", told.one_file)
            else:
                df.show(truncate=False)
        print(f"{file.stem}: {engine.profiler.steps[-1][1]:.0f} ms")
    if told.profile:
        engine.profiler.write(told.profile)


if __name__ == "__main__":
    main()
