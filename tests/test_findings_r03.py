"""The findings of round 3."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from fathom.catalogue import ORACLES, QUERIES
from fathom.plans.statements import column_stats

from .conftest import SMALL


def test_lateral_order_is_the_windows(spark):
    """the subquery's rows are numbered by price within a customer, whatever order they arrive in."""
    plan = QUERIES["lateral_latest"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"row_number\(\) windowspecdefinition\(o_custkey#\d+L, o_totalprice#\d+ DESC NULLS LAST, o_orderkey#\d+L ASC NULLS LAST", plan), plan


def test_lateral_ties_and_nulls(spark, tmp_path):
    """ties go to the smallest key, null keys and prices come last, null and repeated customers as in SQL."""
    orders = [(None, 1, 10.0), (7, 1, 10.0), (5, 1, 10.0), (4, 1, 9.0), (8, 2, None), (9, 2, 1.0), (10, 3, None), (None, 4, 2.0), (11, None, 3.0), (12, 5, float("nan")), (13, 5, 1e300), (14, 6, -0.0), (15, 6, 0.0)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k,) for k in (1, 2, 2, 3, 4, 5, 6, 99, None)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    c = duckdb.connect()
    for t in ("orders", "customer"):
        c.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(c.sql(ORACLES["lateral_latest"]).fetchall(), key=repr)
    assert sorted(map(tuple, QUERIES["lateral_latest"](spark, str(tmp_path)).collect()), key=repr) == want
    assert (1, 5) in want and want.count((2, 9)) == 2


def test_statistics_memory_of_a_task(spark, tmp_path):
    """one file of one row group goes to one task, which must not hold its values."""
    n = 300_000
    rows = spark.range(0, n, 1, 1).selectExpr("id AS c_custkey", "concat('Customer#', id) AS c_name", "CAST(id % 25 AS INT) AS c_nationkey", "concat('M', id % 5) AS c_mktsegment")
    rows.write.parquet(f"{tmp_path}/customer.parquet")
    store = spark.sparkContext._jsc.sc().statusStore()
    quantile = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 1)
    quantile[0] = 1.0
    group = f"statistics-{tmp_path}"
    spark.sparkContext.setJobGroup(group, "")
    try:
        got = {r.column: tuple(r)[1:] for r in QUERIES["column_statistics"](spark, str(tmp_path)).collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {"c_custkey": (n, 0, n, "0", str(n - 1)), "c_name": (n, 0, n, "Customer#0", "Customer#99999"), "c_nationkey": (n, 0, 25, "0", "24"), "c_mktsegment": (n, 0, 5, "M0", "M4")}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    tracker = spark.sparkContext.statusTracker()
    stages = [k for j in tracker.getJobIdsForGroup(group) for k in tracker.getJobInfo(j).stageIds]
    peaks = [x.get().peakExecutionMemory().apply(0) for k in stages if (x := store.taskSummary(k, 0, quantile)).isDefined()]
    assert peaks and max(peaks) < 100e6


def test_statistics_of_odd_columns(spark):
    """F2: the exact figures are those of DuckDB and of the plain aggregates, for types that share a slot, null columns, -0.0, NaN, odd names and no rows."""
    kinds = "`a.b` double, f float, i int, j int, k long, s string, t string, b boolean, d date, m decimal(9,2), nothing string"
    rows = [(-0.0, 1.5, 1, None, 5, "x", "x", True, None, None, None), (float("nan"), None, 1, 2, 5, "", "é", False, None, None, None), (None, 1.5, 3, 2, 5, None, "x", None, None, None, None), (2.0, -1.0, 1, -2, 5, "x", "z", True, None, None, None)]
    df = spark.createDataFrame(rows, kinds).withColumn("d", F.expr("CASE WHEN i = 1 THEN DATE '2024-02-29' END")).withColumn("m", F.expr("CAST(i AS DECIMAL(9,2)) / 4").cast("decimal(9,2)"))
    for x in (df, df.where("false"), df.repartition(3)):
        exact, plain = [[tuple(r) for r in column_stats(x, exact=e).collect()] for e in (True, False)]
        assert exact == plain
    assert column_stats(df, exact=True).first().low == "-0.0"
    assert [tuple(r) for r in column_stats(df, ["i", "i"], True).collect()] == [("i", 4, 0, 2, "1", "3")] * 2


@pytest.mark.parametrize("n", [0, 40])
def test_statistics_of_nulls(spark, tmp_path, n):
    """null and repeated values, and an empty table, as in SQL."""
    rows = [(i % 7 if i % 3 else None, f"Customer#{i % 11}" if i % 5 else None, i % 4 if i % 2 else None, None) for i in range(n)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    c = duckdb.connect()
    c.sql(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
    want = c.sql(ORACLES["column_statistics"]).fetchall()
    assert sorted(map(tuple, QUERIES["column_statistics"](spark, str(tmp_path)).select("column", "rows", "nulls", "distinct", "low", "high").collect())) == sorted(want)
