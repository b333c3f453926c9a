"""Queries of the engine over the driver tables, and their SQL for an independent engine.

A query is SQL text that both engines run, or a DataFrame plan (from operators.relational) beside its SQL. Ordered results
carry their rank in the engine's own sort as a column, since the comparison ignores the order of rows. Constants are values that occur in the tables, so that
each comparison differs from its neighbours. The ``csv_`` queries write tables as typed CSV into the shared folder and work on what is read back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.formats import text as as_text
from larkspur.operators import relational as R
from larkspur.plans import dialect
from larkspur.shared import scratch_path
from larkspur.sources import result_csv, typed_csv
from larkspur.sources.catalog import parquet, register_csv_folder

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: The same text for Spark and for the other engine.
SAME_SQL = {
    "join_filter": "select c.c_name, o.o_orderkey, o.o_totalprice from orders o, customer c where o.o_custkey = c.c_custkey and c.c_acctbal > 5000",
    "scan_all": "select * from region",
    "scan_project": "select l_shipdate, l_orderkey from lineitem",
    "filter_datetime_range": "select o_orderkey, o_orderdate from orders where o_totalprice > 100 and o_orderdate > '1996-01-01 00:00:00' and o_orderdate < '1997-01-01 00:00:00' and o_totalprice < 300000",
    "filter_string_eq": "select c_custkey from customer where c_mktsegment = 'BUILDING'",
    "filter_string_cmp": "select p_partkey, p_brand from part where p_brand >= 'Brand#3' and p_brand <> 'Brand#33'",
    "filter_and_chain": "select o_orderkey from orders where o_totalprice > 20000 and o_totalprice < 200000 and o_custkey > 50 and o_custkey < 800",
    "filter_or": "select p_partkey from part where p_size = 1 or p_size = 7 or p_brand = 'Brand#12'",
    "filter_mixed": "select o_orderkey, o_totalprice from orders where o_orderdate > '1996-10-23 00:00:00' and o_custkey < 1000 or o_totalprice < 30000",
    "filter_nested_mixed": "select o_orderkey from orders where (o_totalprice < 30000 or o_orderstatus = 'F') and (o_custkey < 500 or o_orderdate >= '1997-01-01 00:00:00')",
    "project_cast": "select cast(floor(o_totalprice) as bigint) as k, cast(o_custkey as varchar(20)) as c from orders",
    "join_explicit": "select o.o_orderkey, c.c_name from orders o join customer c on o.o_custkey = c.c_custkey where o.o_totalprice > 150000",
    "join_threeway": "select p.p_name, o.o_orderdate, c.c_name, l.l_extendedprice from lineitem l, orders o, customer c, part p where l.l_orderkey = o.o_orderkey and o.o_custkey = c.c_custkey and l.l_partkey = p.p_partkey and l.l_extendedprice > 40000 and p.p_retailprice < 1500",
    "join_self": "select a.n_nationkey as x, b.n_name as y from nation a, nation b where a.n_regionkey = b.n_regionkey",
    "join_string_key": "select a.c_custkey as x, b.c_custkey as y from customer a join customer b on a.c_name = b.c_name",
    "join_datetime_key": "select o.o_orderkey, d.k from orders o join (select l_shipdate, min(l_orderkey) as k from lineitem group by l_shipdate) d on o.o_orderdate = d.l_shipdate where o.o_totalprice > 250000",
    "join_inequality": "select a.n_name as x, b.r_name as y from nation a join region b on a.n_regionkey > b.r_regionkey",
    "filter_string_lt": "select p_partkey, p_brand from part where p_brand < 'Brand#22'",
    "filter_string_le": "select p_partkey, p_brand from part where p_brand <= 'Brand#22'",
    "filter_string_gt": "select p_partkey, p_brand from part where p_brand > 'Brand#22'",
    "agg_first": "select first(r_name) as only_name, first(r_regionkey) as only_key from region where r_regionkey = 2",
    "agg_count_nulls": "select count(*) as n, count(nullif(p_size, 10)) as sized, count(nullif(p_brand, 'Brand#22')) as branded, min(nullif(p_size, 1)) as lo from part",
    "join_theta": "select a.n_name as x, b.n_name as y from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey",
    "scalar_min": "select o_orderkey, p_name from lineitem l, orders o, part p where l.l_orderkey = o.o_orderkey and l.l_partkey = p.p_partkey and p.p_retailprice <= (select min(p_retailprice) + 5 from part)",
    "scalar_avg": "select c.c_name, o.o_orderkey from customer c, orders o where o.o_custkey = c.c_custkey and o.o_totalprice > (select avg(o_totalprice) from orders)",
    "scalar_datetime": "select o_orderkey from orders where o_orderdate > (select min(l_shipdate) from lineitem)",
    "scalar_first_row": "select o_orderkey from orders where o_totalprice > (select c_acctbal from customer order by c_acctbal desc, c_custkey limit 1)",
    "correlated_sum": "select c.c_name, (select round(sum(o.o_totalprice), 2) from orders o where o.o_custkey = c.c_custkey) as total from customer c",
    "threeway_full": "select c.c_name, o.o_orderkey, p.p_name from customer c, orders o, lineitem l, part p where o.o_custkey = c.c_custkey and l.l_orderkey = o.o_orderkey and l.l_partkey = p.p_partkey and p.p_retailprice > 909 and o.o_orderdate > '1995-06-01 00:00:00' and o.o_totalprice > (select avg(o_totalprice) from orders)",
    "agg_join": "select min(o.o_totalprice) as least, max(o.o_totalprice) as most, count(o.o_orderkey) as n from orders o, customer c where o.o_custkey = c.c_custkey and c.c_acctbal > 5000",
    "agg_avg_join": "select round(avg(o.o_totalprice), 6) as mean from orders o, customer c where o.o_custkey = c.c_custkey",
    "agg_empty": "select count(*) as n, count(o_orderkey) as k, sum(o_totalprice) as s, avg(o_totalprice) as a, min(o_orderstatus) as lo, max(o_orderdate) as hi from orders where o_totalprice < 0",
}

#: Name to (SQL for Spark, SQL for the other engine) where the two differ.
OWN_SQL = {
    "scalar_first_row_select": (dialect.first_row_scalars("select n_nationkey, (select r_name from region order by r_regionkey desc) as last_region from nation"), "select n_nationkey, (select r_name from region order by r_regionkey desc limit 1) as last_region from nation"),
    "scalar_first_row_left": (dialect.first_row_scalars("select p_partkey from part where (select s_suppkey from supplier order by s_suppkey desc) < p_partkey"), "select p_partkey from part where (select max(s_suppkey) from supplier) < p_partkey"),
    "agg_sum_int": ("select sum(p_size) as s from part", "select cast(sum(p_size) as bigint) as s from part"),
}


def _comparison(op: str):
    return lambda t: R.where(t["lineitem"], R.compare("l_quantity", op, 25.0), R.compare("l_linenumber", "!=", 3)).select("l_orderkey", "l_linenumber", "l_quantity")


def _comparison_sql(op: str) -> str:
    return f"select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity {op} 25 and l_linenumber <> 3"


def _scalar(op: str):
    return lambda t: R.scalar_compare(t["lineitem"], "l_quantity", op, R.aggregate(t["lineitem"].where("l_quantity > 24"), ("min", "l_quantity", "x"))).select("l_orderkey", "l_linenumber")


def _equals_and_not(t):
    return t["part"].where((R.compare("p_size", "=", 10)) | ~(R.compare("p_size", ">", 3))).select("p_partkey", "p_size")


def _all_aggregates(t):
    o = t["orders"]
    out = R.aggregate(o, ("count", "*", "n"), ("count", "o_orderstatus", "n_status"), ("sum", "o_totalprice", "s"), ("avg", "o_totalprice", "a"), ("min", "o_totalprice", "lo"), ("max", "o_totalprice", "hi"), ("min", "o_orderdate", "lo_date"), ("max", "o_orderdate", "hi_date"), ("min", "o_orderpriority", "lo_text"), ("max", "o_orderpriority", "hi_text"))
    return out.withColumns({"s": F.round("s", 2), "a": F.round("a", 6)})


#: Name to (DataFrame plan over the tables, SQL for the other engine).
PLANS: dict[str, tuple[Callable, str]] = {
    **{f"filter_{n}": (_comparison(op), _comparison_sql(op)) for n, op in (("gt", ">"), ("lt", "<"), ("eq", "="), ("ne", "!="), ("le", "<="), ("ge", ">="))},
    "filter_eq_or_not": (_equals_and_not, "select p_partkey, p_size from part where p_size = 10 or not p_size > 3"),
    "project_reorder": (lambda t: R.project(t["customer"], ["c_mktsegment", "c_custkey"]), "select c_mktsegment, c_custkey from customer"),
    "project_positional": (lambda t: R.project(t["orders"], [3, 0, 5], names=["price", "k", "priority"]), "select o_totalprice as price, o_orderkey as k, o_orderpriority as priority from orders"),
    "join_equi": (lambda t: R.equi_join(t["orders"], R.small(t["customer"]), [("o_custkey", "c_custkey")]).select("o_orderkey", "c_name"), "select o_orderkey, c_name from orders, customer where o_custkey = c_custkey"),
    "join_composite": (
        lambda t: R.equi_join(t["lineitem"].alias("a"), R.project(t["lineitem"], ["l_orderkey", "l_linenumber", "l_tax"], names=["k", "line", "tax"]), [("l_orderkey", "k"), ("l_linenumber", "line")]).select("l_orderkey", "l_linenumber", "tax"),
        "select a.l_orderkey, a.l_linenumber, b.l_tax as tax from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber = b.l_linenumber",
    ),
    **{
        f"nlj_scalar_{n}": (_scalar(op), f"select l_orderkey, l_linenumber from lineitem where l_quantity {op} (select min(l_quantity) from lineitem where l_quantity > 24)")
        for n, op in (("gt", ">"), ("lt", "<"), ("eq", "="), ("ne", "<>"), ("le", "<="), ("ge", ">="))
    },
    "agg_all": (_all_aggregates, "select count(*) as n, count(o_orderstatus) as n_status, round(sum(o_totalprice), 2) as s, round(avg(o_totalprice), 6) as a, min(o_totalprice) as lo, max(o_totalprice) as hi, min(o_orderdate) as lo_date, max(o_orderdate) as hi_date, min(o_orderpriority) as lo_text, max(o_orderpriority) as hi_text from orders"),
    "order_num_desc": (lambda t: R.ranked(t["orders"].select("o_orderkey", "o_totalprice"), ("o_totalprice", "desc"), "o_orderkey"), "select o_orderkey, o_totalprice, row_number() over (order by o_totalprice desc nulls last, o_orderkey) as position from orders"),
    "order_ts_asc": (lambda t: R.ranked(t["orders"].select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey"), "select o_orderkey, o_orderdate, row_number() over (order by o_orderdate asc nulls last, o_orderkey) as position from orders"),
    "order_str_asc": (lambda t: R.ranked(t["customer"].select("c_custkey", "c_name"), "c_name", "c_custkey"), "select c_custkey, c_name, row_number() over (order by c_name asc nulls last, c_custkey) as position from customer"),
    "order_multi": (lambda t: R.ranked(t["part"].select("p_partkey", "p_brand", "p_size"), ("p_brand", "desc"), "p_size", "p_partkey"), "select p_partkey, p_brand, p_size, row_number() over (order by p_brand desc nulls last, p_size asc nulls last, p_partkey) as position from part"),
    "order_alias": (
        lambda t: R.ranked(t["orders"].groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total")), ("total", "desc"), "o_custkey"),
        "select o_custkey, total, row_number() over (order by total desc nulls last, o_custkey) as position from (select o_custkey, round(sum(o_totalprice), 2) as total from orders group by o_custkey)",
    ),
    "sort_global": (
        lambda t: R.ranked(t["lineitem"].select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") != 7, F.col("l_quantity")).alias("q"), "l_extendedprice"), ("q", "desc"), "l_extendedprice", "l_orderkey", "l_linenumber"),
        "select l_orderkey, l_linenumber, q, l_extendedprice, row_number() over (order by q desc nulls last, l_extendedprice, l_orderkey, l_linenumber) as position from (select l_orderkey, l_linenumber, case when l_quantity <> 7 then l_quantity end as q, l_extendedprice from lineitem)",
    ),
    "sink_format": (
        lambda t: t["orders"].select("o_orderkey", as_text(t["orders"].schema["o_totalprice"], F.col("o_totalprice")).alias("price"), as_text(t["orders"].schema["o_orderdate"], F.col("o_orderdate")).alias("day")),
        "select o_orderkey, printf('%.2f', o_totalprice) as price, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as day from orders",
    ),
}


#: Header cell and SQL text of each cell of the CSV tables that the queries below write.
ORDERS_CSV = {
    "o_orderkey (N) (P)": "cast(o_orderkey as string)",
    "o_custkey (N)": "cast(o_custkey as string)",
    "o_orderdate (D)": "date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss')",
    "o_totalprice (N)": "case when o_orderkey % 11 = 0 then 'n/a' when o_orderkey % 7 = 0 then '' else format_string('%.2f', o_totalprice) end",
    "status, priority (T)": "concat(o_orderstatus, ', ', o_orderpriority)",
}
CUSTOMER_CSV = {"c_custkey (N) (P)": "cast(c_custkey as string)", "c_name (T)": "c_name", "c_acctbal (N)": "format_string('%.2f', c_acctbal)", "note": "case when c_custkey % 2 = 0 then c_mktsegment end"}
#: The same table in the other engine's SQL.
ORDERS_READ = "select cast(o_orderkey as double) as o_orderkey, cast(o_custkey as double) as o_custkey, o_orderdate, case when o_orderkey % 11 <> 0 and o_orderkey % 7 <> 0 then o_totalprice end as o_totalprice, o_orderstatus || ', ' || o_orderpriority as \"status, priority\" from orders"


def typed_table(df: DataFrame, cells: dict[str, str], path: str, short: str | None = None) -> None:
    """Writes ``df`` as typed CSV text; where ``short`` holds, rows end before their last two cells."""
    rows = df.selectExpr(*[f"{text} as `{k}`" for k, text in enumerate(cells.values())], f"{short or 'false'} as short")
    quoted = [F.when(F.col(f"`{k}`").contains(","), F.concat(F.lit('"'), f"`{k}`", F.lit('"'))).otherwise(F.coalesce(f"`{k}`", F.lit(""))) for k in range(len(cells))]
    header = ",".join(f'"{x}"' if "," in x else x for x in cells)
    lines = rows.select(F.concat_ws(",", *quoted[:-2], F.when(~F.col("short"), F.concat_ws(",", *quoted[-2:]))).alias("line")).toDF(header)
    # lines are whole already: one column, with a separator and a quote that no line holds
    lines.write.mode("overwrite").option("header", True).option("sep", "\x01").option("quote", "").option("escapeQuotes", False).option("lineSep", "\r\n").csv(path)


def _csv_tables(t, short: str | None = None) -> str:
    folder = scratch_path(t.spark, "typed-csv")
    typed_table(t["orders"], ORDERS_CSV, f"{folder}/orders_csv.csv", short)
    typed_table(t["customer"], CUSTOMER_CSV, f"{folder}/customer_csv.csv")
    return folder


def _csv_scan(t, short: str | None = None) -> DataFrame:
    return typed_csv.read(t.spark, f"{_csv_tables(t, short)}/orders_csv.csv")


def _csv_catalog(t) -> DataFrame:
    register_csv_folder(t.spark, _csv_tables(t))
    return t.spark.sql("select o.o_orderkey, c.c_name, c.note, o.o_totalprice from orders_csv o join customer_csv c on o.o_custkey = c.c_custkey where o.o_totalprice > 100000 and o.o_orderdate >= timestamp_ntz '1996-05-01 00:00:00'")


def _csv_sink(t) -> DataFrame:
    """The lines of the result file, read back as text."""
    path = scratch_path(t.spark, "result")
    result_csv.write(_csv_scan(t).select("o_orderkey", "o_orderdate", "o_totalprice", "`status, priority`"), path)
    lines = t.spark.read.text(path)
    return lines.where("value <> 'o_orderkey,o_orderdate,o_totalprice,\"status, priority\"'").withColumnRenamed("value", "line")


def _whole_numbers(t) -> DataFrame:
    """Numbers that a double does not hold."""
    df = t["orders"].select("o_orderkey", (F.col("o_orderkey") + 9007199254740993).alias("big"), (F.col("o_orderkey").cast("decimal(20,0)") + F.lit("0.125").cast("decimal(4,3)")).alias("exact"))
    return df.select("o_orderkey", *[as_text(df.schema[x], F.col(x)).alias(x) for x in ("big", "exact")])


PLANS |= {
    "csv_scan": (_csv_scan, ORDERS_READ),
    "csv_project": (lambda t: _csv_scan(t).select("o_totalprice", "o_orderkey"), f"select o_totalprice, o_orderkey from ({ORDERS_READ})"),
    "csv_short_rows": (lambda t: _csv_scan(t, "o_orderkey % 3 = 0"), 'select o_orderkey, o_custkey, o_orderdate, case when o_orderkey % 3 <> 0 then o_totalprice end as o_totalprice, case when o_orderkey % 3 <> 0 then "status, priority" end as "status, priority" from (' + ORDERS_READ + ")"),
    "csv_catalog": (_csv_catalog, f"select o.o_orderkey, c.c_name, case when c.c_custkey % 2 = 0 then c.c_mktsegment end as note, o.o_totalprice from ({ORDERS_READ}) o join customer c on o.o_custkey = c.c_custkey where o.o_totalprice > 100000 and o.o_orderdate >= '1996-05-01 00:00:00'"),
    "csv_count_nulls": (lambda t: R.aggregate(_csv_scan(t), ("count", "*", "n"), ("count", "o_totalprice", "priced"), ("max", "o_totalprice", "most")), f"select count(*) as n, count(o_totalprice) as priced, max(o_totalprice) as most from ({ORDERS_READ})"),
    "csv_sink": (_csv_sink, f"select printf('%.2f', o_orderkey) || ',' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || ',' || coalesce(printf('%.2f', o_totalprice), '') || ',\"' || \"status, priority\" || '\"' as line from ({ORDERS_READ})"),
    "sink_whole_numbers": (_whole_numbers, "select o_orderkey, cast(o_orderkey + 9007199254740993 as varchar) || '.00' as big, cast(o_orderkey as varchar) || '.13' as exact from orders"),
}


class Tables(dict):
    """Tables of a folder, read when first used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        self[name] = df = parquet(self.spark, self.sf_dir, name)
        return df


def _sql_query(text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for name in TABLES:
            if name in text:
                parquet(spark, sf_dir, name).createOrReplaceTempView(name)
        return spark.sql(text)

    return run


def _plan_query(plan: Callable):
    return lambda spark, sf_dir: plan(Tables(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{name: _sql_query(text) for name, text in SAME_SQL.items()},
    **{name: _sql_query(text) for name, (text, _) in OWN_SQL.items()},
    **{name: _plan_query(plan) for name, (plan, _) in PLANS.items()},
}
ORACLE_SQL: dict[str, str] = SAME_SQL | {name: text for name, (_, text) in OWN_SQL.items()} | {name: text for name, (_, text) in PLANS.items()}
