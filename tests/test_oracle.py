"""Every engine query against its SQL in DuckDB, over the driver's smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from larkspur.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return db


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    assert sorted(a.columns) == sorted(b.columns)
    columns = sorted(a.columns)
    rows = [sorted(map(tuple, x[columns].astype(object).where(x[columns].notna(), None).values.tolist()), key=repr) for x in (a, b)]
    assert len(rows[0]) == len(rows[1])
    for x, y in zip(*rows, strict=True):
        for p, q in zip(x, y, strict=True):
            assert p == q or p == pytest.approx(q, rel=1e-9), (x, y)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    same(QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("names", [("filter_gt", "filter_lt", "filter_eq", "filter_ne", "filter_le", "filter_ge"), ("nlj_scalar_gt", "nlj_scalar_lt", "nlj_scalar_eq", "nlj_scalar_ne", "nlj_scalar_le", "nlj_scalar_ge"), ("filter_string_lt", "filter_string_le", "filter_string_gt")])
def test_comparisons_differ(duck, names):
    """No two comparisons have the same rows, and none is empty: a wrong sign would show."""
    found = [frozenset(duck.execute(ORACLE_SQL[x]).fetchall()) for x in names]
    assert len(set(found)) == len(names) and all(found)


def test_results_are_not_empty(duck):
    assert [x for x, text in ORACLE_SQL.items() if not duck.execute(text).fetchone()] == []


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_window_in_one_task(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "CartesianProduct" not in plan


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
