"""The three sample tables of ten rows, read as typed CSV, through the operators; the results are known from the rows."""

import pytest
from pyspark.sql import functions as F

from larkspur.operators import relational as R
from larkspur.plans.engine import Engine

# The sample tables' rows and what ten questions about them give.
SALARY = [67582.53, 94766.24, 100392.09, 61630.91, 101049.24, 95242.53, 76650.39, 78939.67, 106030.37, 108835.78]
JOINED = ["2017-06-02", "2022-02-03", "2018-08-29", "2021-03-03", "2024-07-04", "2017-01-24", "2016-04-25", "2023-02-15", "2016-01-02", "2015-08-24"]
PRICE = [562.53, 754.92, 534.4, 940.3, 883.59, 357.09, 592.23, 189.1, 456.9, 102.09]
RELEASED = ["2023-02-10", "2019-06-04", "2017-05-23", "2015-09-24", "2020-05-24", "2018-03-14", "2025-02-08", "2017-06-06", "2023-11-08", "2016-10-30"]
AMOUNT = [4432.58, 854.07, 201.72, 3545.54, 223.88, 4968.13, 76.42, 4968.07, 2584.7, 2664.86]
ORDERED = ["2024-06-01", "2025-01-05", "2024-06-04", "2025-04-06", "2025-04-11", "2024-07-31", "2024-07-15", "2024-10-10", "2024-12-10", "2025-02-20"]
PRODUCT = [4, 5, 5, 1, 1, 2, 3, 9, 3, 9]
EMPLOYEE = [2, 7, 10, 3, 9, 3, 8, 9, 4, 8]
TIME = " 19:34:34"


@pytest.fixture(scope="module")
def t(spark, tmp_path_factory):
    folder, ids = tmp_path_factory.mktemp("samples"), range(1, 11)
    columns = {
        "Employee": {"Employee_id (N)": ids, "Name (T)": [f"Employee_{k}" for k in ids], "Salary (N)": SALARY, "JoinedDate (D)": [x + TIME for x in JOINED]},
        "Product": {"Product_id (N)": ids, "ProductName (T)": [f"Product_{k}" for k in ids], "Price (N)": PRICE, "ReleaseDate (D)": [x + TIME for x in RELEASED]},
        "Orders": {"Order_id (N)": ids, "CustomerName (T)": [f"Customer_{k}" for k in ids], "TotalAmount (N)": AMOUNT, "OrderDate (D)": [x + TIME for x in ORDERED], "Product_id (N)": PRODUCT, "Employee_id (N)": EMPLOYEE},
    }
    for name, own in columns.items():
        lines = [",".join(own), *(",".join(map(str, x)) for x in zip(*own.values(), strict=True))]
        (folder / f"{name}.csv").write_bytes("".join(x + "\r\n" for x in lines).encode())
    Engine(spark).load(str(folder))
    return {name: spark.table(name) for name in columns}


def values(df):
    return [r[0] for r in df.collect()]


def joined(t, *names):
    """Orders with the named tables, each once."""
    out = t["Orders"]
    for name in names:
        key = f"{name}_id"
        out = R.equi_join(out, t[name].withColumnRenamed(key, "other"), [(key, "other")]).drop("other")
    return out


def mean(t):
    return R.aggregate(t["Orders"], ("avg", "TotalAmount", "x"))


def test_customers_of_dear_products(t):
    found = R.where(joined(t, "Product"), R.compare("Price", ">", 700))
    assert set(values(found.select("CustomerName"))) == {"Customer_1", "Customer_2", "Customer_3", "Customer_6"}


def test_by_salary(t):
    found = R.order_by(R.where(joined(t, "Employee"), R.compare("TotalAmount", ">", 1000)), ("Salary", "desc"))
    assert values(found.select("Employee_id")) == [9, 3, 3, 2, 8, 4]


def test_by_price_above_the_least_amount(t):
    found = R.scalar_compare(joined(t, "Product"), "Price", ">", R.aggregate(t["Orders"], ("min", "TotalAmount", "x")))
    assert values(R.order_by(found, ("Price", "desc"), "Order_id").select("Order_id")) == [1, 2, 3, 6, 4, 5, 7, 9, 8, 10]


def test_above_the_mean(t):
    found = R.order_by(R.scalar_compare(joined(t, "Employee"), "TotalAmount", ">", mean(t)), "Name")
    assert values(found.select("Name")) == [f"Employee_{k}" for k in (2, 3, 3, 4, 8, 9)]
    assert mean(t).first().x == pytest.approx(2451.997)


def test_three_tables(t):
    found = R.where(joined(t, "Product", "Employee"), R.compare("Price", ">", 300), R.compare("JoinedDate", ">", F.lit("2020-05-11").cast("timestamp_ntz")))
    found = R.order_by(R.scalar_compare(found, "TotalAmount", ">", mean(t)), "Employee_id")
    assert values(found.select("Name")) == ["Employee_2", "Employee_4", "Employee_8"]
    # among orders above 1000, those of cheap products
    cheap = R.order_by(R.where(joined(t, "Product", "Employee"), R.compare("TotalAmount", ">", 1000), R.compare("Price", "<", 500)), "TotalAmount")
    assert [tuple(r) for r in cheap.select("ProductName", "Name", "TotalAmount").collect()] == [("Product_9", "Employee_8", 2664.86), ("Product_9", "Employee_9", 4968.07)]


def test_either_or(t):
    found = R.where(t["Orders"], R.compare("OrderDate", ">", F.lit("2023-10-23").cast("timestamp_ntz")) & R.compare("Product_id", "<", 1000) | R.compare("TotalAmount", "<", 300))
    assert values(R.order_by(found, ("TotalAmount", "desc")).select("Order_id")) == [6, 8, 1, 4, 10, 9, 2, 5, 3, 7]


def test_sales_of_each(t):
    total = t["Orders"].groupBy("Employee_id").agg(F.sum("TotalAmount").alias("total"))
    found = R.order_by(R.equi_join(t["Employee"], total.withColumnRenamed("Employee_id", "of"), [("Employee_id", "of")], how="left"), ("total", "desc"), "Employee_id")
    assert values(found.select("Employee_id")) == [3, 9, 2, 8, 4, 7, 10, 1, 5, 6]
    assert [x and round(x, 2) for x in values(found.select("total"))] == [8513.67, 5191.95, 4432.58, 2741.28, 2584.7, 854.07, 201.72, None, None, None]


def test_times(t):
    day = lambda x: F.lit(x).cast("timestamp_ntz")
    found = R.where(t["Orders"], R.compare("TotalAmount", ">", 100), R.compare("OrderDate", ">", day("2010-01-01")), R.compare("OrderDate", "<", day("2025-01-01")))
    assert values(R.order_by(found, "OrderDate").select("Order_id")) == [1, 3, 6, 8, 9]


def test_aggregates(t):
    row = R.aggregate(R.where(joined(t, "Employee"), R.compare("Salary", ">", 5000)), ("min", "TotalAmount", "lo"), ("max", "TotalAmount", "hi"), ("count", "Order_id", "n")).first()
    assert tuple(row) == (76.42, 4968.13, 10)


def test_release_dates(t):
    assert [str(x) for x in values(R.order_by(t["Product"], "Product_id").select("ReleaseDate"))] == [x + TIME for x in RELEASED]
