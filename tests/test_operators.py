import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.operators import relational as R


@pytest.fixture(scope="module")
def t(spark):
    return spark.createDataFrame([(1, "a", 1.0), (2, "b", None), (None, "c", 3.0), (2, None, 2.0)], "k int, s string, x double").cache()


def test_project(t):
    assert R.project(t, [2, "k"], casts={"k": "string"}).dtypes == [("x", "double"), ("k", "string")]
    assert R.project(t, [1], names=["z"]).columns == ["z"]


@pytest.mark.parametrize("op,keys", [(">", [2, 2]), ("<", []), ("=", [1]), ("!=", [2, 2]), ("<=", [1]), (">=", [1, 2, 2])])
def test_compare_leaves_unknown_out(t, op, keys):
    assert sorted(r.k for r in R.where(t, R.compare("k", op, 1)).collect()) == keys


def test_null_keys_do_not_join(t):
    other = R.project(t, ["k", "x"], names=["k2", "y"])
    assert R.equi_join(t, other, [("k", "k2")]).count() == 5
    assert R.equi_join(t, other, [("k", "k2"), ("x", "y")]).count() == 2
    assert R.theta_join(t, other, F.col("k") < F.col("k2")).count() == 2
    assert R.equi_join(t, other.where("false"), [("k", "k2")]).count() == 0


def test_keys_of_different_kinds_are_an_error(t):
    other = R.project(t, ["k", "s", "x"], names=["k2", "s2", "x2"])
    assert R.equi_join(t, other, [("k", "x2")]).count() == 3  # whole numbers with doubles
    with pytest.raises(TypeError, match="k is a number, s2 a string"):
        R.equi_join(t, other, [("k", "s2")])
    with pytest.raises(TypeError, match="d is a time"):
        R.equi_join(t.withColumn("d", F.current_timestamp()), other, [("d", "s2")])


def test_ranked(spark):
    rows = [(k * 7919 % 1000, k % 13 if k % 5 else None) for k in range(1000)]
    df = spark.createDataFrame(rows, "k int, v int").repartition(7)
    found = R.ranked(df, ("v", "desc"), "k")
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [(r.k, r.v) for r in sorted(found.collect(), key=lambda r: r.position)] == want
    assert sorted(r.position for r in found.collect()) == list(range(1, 1001))
    assert R.ranked(df.where("false"), "k").count() == 0


def test_small_is_bounded(t):
    assert "broadcast" in R.small(t)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in R.small(t, limit=0)._jdf.queryExecution().logical().toString().lower()


def test_scalar(t):
    assert [r.x for r in R.scalar_compare(t, "x", "=", R.aggregate(t, ("max", "x", "m"))).collect()] == [3.0]
    assert R.scalar_compare(t, "x", "=", R.aggregate(t.where("false"), ("max", "x", "m"))).count() == 0
    first = R.first_row(t.select("x"), F.col("x").asc_nulls_last())
    assert R.scalar_compare(t, "x", ">", first).count() == 2


def test_aggregate_of_nothing(t):
    row = R.aggregate(t.where("false"), ("count", "*", "n"), ("sum", "x", "s"), ("min", "s", "lo")).first()
    assert (row.n, row.s, row.lo) == (0, None, None)


def test_order(t):
    assert [r.k for r in R.order_by(t, ("k", "desc"), "x").collect()] == [2, 2, 1, None]
    assert [r.s for r in R.order_by(t, "s").collect()] == ["a", "b", "c", None]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-3, 3)), st.one_of(st.none(), st.floats(-5, 5, width=32))), max_size=12), st.sampled_from([">", "<", "=", "!=", "<=", ">="]), st.integers(-3, 3))
def test_filter_like_python(spark, rows, op, value):
    import operator

    ops = {">": operator.gt, "<": operator.lt, "=": operator.eq, "!=": operator.ne, "<=": operator.le, ">=": operator.ge}
    df = spark.createDataFrame(rows, "k int, x double")
    got = R.where(df, R.compare("k", op, value) | R.compare("x", op, float(value))).count()
    assert got == sum(any(v is not None and ops[op](v, value) for v in r) for r in rows)
