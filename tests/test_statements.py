"""Statements beyond Spark's: definitions are taken whole or refused, and nothing answers from what is out of date."""

import warnings

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from fathom.operators import cohort, flatjson, funnel, paths
from fathom.plans import preagg
from fathom.plans.registry import State
from fathom.plans.statements import Engine, UnsupportedStatement, parse_aggregate, split_top
from fathom.sources import tables
from fathom.streaming import ingest

from .conftest import SMALL

FUNNEL = "FUNNEL_COUNT(user_key => user_id, event_col => event_type, time_col => ts, steps => ['view', 'click'], time_window => INTERVAL 12 HOUR)"


@pytest.fixture
def engine(spark):
    tables.events(spark, SMALL).write.mode("overwrite").saveAsTable("st_events")
    yield Engine(spark)
    spark.sql("DROP TABLE IF EXISTS st_events")


def test_create_table_is_sparks(engine, spark):
    engine.sql("CREATE TABLE st_pt (a INT, b INT) USING parquet PARTITIONED BY (a)")
    assert spark.table("st_pt").columns == ["b", "a"]
    engine.sql("DROP TABLE st_pt")
    engine.sql("CREATE TABLE st_d (a INT, d DECIMAL(10, 2)) USING parquet")
    assert dict(spark.table("st_d").dtypes)["d"] == "decimal(10,2)"
    engine.sql("DROP TABLE st_d")
    engine.sql("CREATE TABLE st_c (a BIGINT, d DECIMAL(10, 2), s VARCHAR(9)) ORDER BY (a) PROPERTIES ('x' = 'y')")
    assert dict(spark.table("st_c").dtypes) == {"a": "bigint", "d": "decimal(10,2)", "s": "string"} and engine._properties("st_c")["x"] == "y"
    engine.sql("DROP CUBE st_c")


@pytest.mark.parametrize("text", ["CREATE CUBE c (a INT) SOMETHING ELSE", "CREATE CUBE c (a INT b INT)", "CREATE CUBE c (a INT, a INT)", "CREATE CUBE c (a WIDGET)", "CREATE CUBE c (a INT) ORDER BY (z)", "CREATE CUBE c (a INT) PARTITION BY RANGE(a) AUTO", "CREATE CUBE c (a INT) DISTRIBUTED BY HASH(z)", "CREATE CUBE c (a INT", "CREATE MATERIALIZED VIEW v AS SELECT a, COUNT(*) FROM t", "CREATE MATERIALIZED VIEW v AS SELECT a, MEDIAN(b) AS m FROM t GROUP BY a", "CREATE MATERIALIZED VIEW v AS SELECT COUNT(*) AS n FROM t GROUP BY a", "CREATE MATERIALIZED VIEW v AS SELECT a, b + 1, COUNT(*) AS n FROM t GROUP BY a", "ALTER CUBE st_events MOVE x", "ALTER CUBE st_events DROP COLUMN nothing", "ALTER CUBE st_events ADD COLUMN value INT", "ALTER CUBE nowhere ADD COLUMN a INT", "CREATE SESSION MATERIALIZED VIEW v FROM st_events USER KEY user_id SESSION TIMEOUT 3 MOONS"])
def test_nothing_is_swallowed(engine, text):
    with pytest.raises(ValueError):
        engine.sql(text)
    assert not engine.views and not engine.registry.layouts


def test_definitions_are_whole():
    spec, order = parse_aggregate("COUNT(*), SUM(t * (2 + x)) AS z, MAX(t) AS hi, g, date(ts) AS day", "T", "a = 'x AND y' AND b > 1", "g, date(ts)")
    assert spec.aggs == (("count", "*", "count(1)"), ("sum", "t * (2 + x)", "z"), ("max", "t", "hi")) and order == ["count(1)", "z", "hi", "g", "day"]
    assert spec.group_by == ("g", "day") and spec.exprs == (("day", "date(ts)"),) and spec.filters == (("a", "a = 'x AND y'"), ("b", "b > 1"))
    assert split_top("f(a, b), 'x,y', c") == ["f(a, b)", "'x,y'", "c"]


def test_rewriting_is_transparent_and_fresh(engine, spark):
    engine.sql("CREATE MATERIALIZED VIEW st_mv AS SELECT event_type, user_id, COUNT(*) AS n, SUM(value) AS s, AVG(value) AS m FROM st_events GROUP BY event_type, user_id")
    q = "SELECT COUNT(*) AS n, event_type FROM st_events WHERE user_id > 3 GROUP BY event_type"
    plain = lambda: sorted(map(tuple, spark.sql(q).collect()))
    got = engine.sql(q)
    assert engine.last_route == "st_mv" and got.columns == ["n", "event_type"] and sorted(map(tuple, got.collect())) == plain()
    assert "st_events" not in got._jdf.queryExecution().optimizedPlan().toString().replace("st_mv_state", "")
    for write in ("INSERT INTO st_events SELECT * FROM st_events LIMIT 40", "DELETE FROM st_events WHERE event_type = 'view'"):
        engine.last_route = ""
        engine.sql(write)
        assert sorted(map(tuple, engine.sql(q).collect())) == plain() and engine.last_route == ""
        engine.sql("REFRESH MATERIALIZED VIEW st_mv")
        assert sorted(map(tuple, engine.sql(q).collect())) == plain() and engine.last_route == "st_mv"
    engine.last_route = ""
    spark.sql("INSERT INTO st_events SELECT * FROM st_events LIMIT 10")  # past the engine
    assert sorted(map(tuple, engine.sql(q).collect())) == plain() and engine.last_route == ""
    for other in ("SELECT event_type, MAX(value) AS x FROM st_events GROUP BY event_type", "SELECT event_type FROM st_events", "SELECT event_type, COUNT(*) AS n FROM st_events WHERE value > 1 GROUP BY event_type"):
        assert sorted(map(tuple, engine.sql(other).collect())) == sorted(map(tuple, spark.sql(other).collect())) and engine.last_route == ""
    engine.sql("DROP MATERIALIZED VIEW st_mv")
    assert not engine.views


def test_session_tables_are_stored_and_fresh(engine, spark):
    engine.sql("CREATE SESSION MATERIALIZED VIEW st_s FROM st_events USER KEY user_id SESSION TIMEOUT 12 HOURS REFRESH SCHEDULED '0 3 * * *'")
    x = engine.registry.layouts["st_s"]
    assert x.state is State.ACTIVE and spark.table("st_s").count() == x.rows and x.source_rows == spark.table("st_events").count()
    q = f"SELECT {FUNNEL} FROM st_events"
    want = lambda: sorted(funnel.funnel_anchored(spark.table("st_events"), ["view", "click"], 43200).collect())
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    hint = q.replace("SELECT", "SELECT /*+ FORCE_BT(st_s) */", 1)
    assert "event_sequence" in plan(engine.sql(hint)) and sorted(engine.sql(hint).collect()) == want()
    assert "event_sequence" not in plan(engine.sql(q.replace("SELECT", "SELECT /*+ NO_BT */", 1)))
    assert "Exchange hashpartitioning(user" not in engine.sql(hint)._jdf.queryExecution().executedPlan().toString()
    engine.sql("INSERT INTO st_events SELECT event_id + 1000000, ts + INTERVAL 1 HOUR, user_id, 'click', value, props FROM st_events")
    assert engine.sql("EXPLAIN BEHAVIORAL ROUTING st_events").first().decision == "events" and sorted(engine.sql(hint).collect()) == want()
    engine.sql("REFRESH SESSION MATERIALIZED VIEW st_s")
    assert "event_sequence" in plan(engine.sql(hint)) and sorted(engine.sql(hint).collect()) == want()
    engine.sql("DROP SESSION MATERIALIZED VIEW st_s")
    assert not spark.catalog.tableExists("st_s")


def test_size_decides_when_known(engine):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        engine.sql("CREATE SESSION MATERIALIZED VIEW st_tiny FROM st_events USER KEY user_id SESSION TIMEOUT 1 SECOND")
        assert "small" in engine.sql("EXPLAIN BEHAVIORAL ROUTING st_events").first().reason
        engine.sql("DROP SESSION MATERIALIZED VIEW st_tiny")


def test_funnel_as_an_array(engine, spark):
    got = {r.day: list(r.f) for r in engine.sql(f"SELECT day, {FUNNEL} AS f FROM st_days WHERE value > 1 GROUP BY day").collect()} if spark.table("st_events").selectExpr("*", "day(ts) % 3 AS day").createOrReplaceTempView("st_days") is None else {}
    want = funnel.funnel_anchored(spark.table("st_days").where("value > 1"), ["view", "click"], 43200, by=["day"]).collect()
    assert got == {d: [r.users for r in sorted(want, key=lambda r: r.step) if r.day == d] for d in {r.day for r in want}}
    with pytest.raises(ValueError):
        engine.sql(f"SELECT day, {FUNNEL} AS f FROM st_days GROUP BY value")


def test_writes(engine, spark):
    with pytest.raises(AnalysisException):
        engine.sql("INSERT INTO st_events VALUES (1, 2)")
    n = spark.table("st_events").count()
    kept = spark.table("st_events").where("value <= 50 OR value IS NULL").count()
    engine.sql("DELETE FROM st_events WHERE value > 50")
    assert spark.table("st_events").count() == kept < n
    files = engine.sql("SHOW PARTS FROM st_events")
    assert files.columns == ["part", "bytes", "modified", "rows"] and files.agg(F.sum("rows")).first()[0] == kept
    engine.sql("DELETE FROM st_events")
    assert spark.table("st_events").count() == 0
    with pytest.raises(UnsupportedStatement):
        engine.sql("UPDATE st_events SET value = 1")


def test_cube_columns(engine, spark):
    engine.sql("CREATE CUBE st_cube (id BIGINT, t DATETIME, a INT) PARTITION BY RANGE(t) AUTO ORDER BY (id) DISTRIBUTED BY HASH(id) BUCKETS 2")
    engine.sql("INSERT INTO st_cube VALUES (1, TIMESTAMP '2024-01-31 23:59:59', 5), (2, TIMESTAMP '2024-02-01 00:00:00', 6)")
    assert [tuple(r) for r in spark.sql("SELECT id, p FROM st_cube ORDER BY id").collect()] == [(1, "p_2024_01_31"), (2, "p_2024_02_01")]
    with pytest.raises(ValueError):
        engine.sql("INSERT INTO st_cube VALUES (1, TIMESTAMP '2024-01-31 23:59:59')")
    for column in ("id", "t", "p"):
        with pytest.raises(ValueError):
            engine.sql(f"ALTER CUBE st_cube DROP COLUMN {column}")
    engine.sql("ALTER CUBE st_cube DROP COLUMN a")
    assert sorted(spark.table("st_cube").columns) == ["id", "p", "t"] and spark.table("st_cube").count() == 2
    engine.sql("DROP CUBE st_cube")


def test_results_are_kept_for_a_while(engine, spark):
    engine.most_cached = 2
    a = engine.cached(spark.range(5).selectExpr("id + 1 AS x"))
    assert engine.cached(spark.range(5).selectExpr("id + 1 AS x")) is a
    for k in range(6, 9):
        engine.cached(spark.range(k))
    assert len(engine.cache) == 2 and engine.cached(spark.range(5).selectExpr("id + 1 AS x")) is not a
    engine.changed("st_events")
    assert not engine.cache
    engine.seconds_cached = -1.0
    assert engine.cached(spark.range(3)) is not engine.cached(spark.range(3))


def test_null_dimensions_and_events(spark):
    rows = [(1, 1, "a", None), (2, 2, "b", None), (3, 3, None, None), (4, 4, "c", None), (5, 1, "a", "x")]
    df = spark.createDataFrame(rows, "event_id long, t long, event_type string, dim string").select("event_id", F.timestamp_seconds("t").alias("ts"), F.lit(7).alias("user_id"), "event_type", "dim")
    got = {(r.dim, r.step): (r.users, r.conversion) for r in funnel.funnel_stepwise(df, ["a", "b"], 60, by=["dim"]).collect()}
    assert got == {(None, 1): (1, 1.0), (None, 2): (1, 1.0), ("x", 1): (1, 1.0), ("x", 2): (0, 0.0)}
    assert {r.path for r in paths.ngrams(df.where("dim is null"), 2, None).collect()} == {"a => b", "b => c"}
    assert cohort.first_return(df, F.col("event_type") == "a", F.col("event_type") == "c").first().day_7_retention == 1.0


def test_as_of(spark):
    left = spark.createDataFrame([(1, 10, "p"), (1, 5, "q"), (2, 9, "r"), (None, 9, "s"), (1, 10, "p")], "k int, t int, x string")
    right = spark.createDataFrame([(1, 6, 60), (1, 10, 100), (1, 10, 101), (2, 10, 1), (None, 1, 1)], "k int, t int, v int")
    got = sorted(map(tuple, tables.as_of(left, right, "k", "t", ["v"]).collect()), key=str)
    assert got == sorted([(1, 10, "p", 101), (1, 10, "p", 101), (1, 5, "q", None), (2, 9, "r", None), (None, 9, "s", None)], key=str)


def test_promoted_names_do_not_clash(spark):
    df = spark.createDataFrame([(1, '{"ID": 5, "it\'s": "x"}'), (2, '{"ID": 6, "it\'s": "y"}'), (3, "broken")], "id int, j string")
    out = flatjson.promote(df, "j")
    assert out.columns == ["id", "j", "ID_", "it's"] and [tuple(r)[2:] for r in out.orderBy("id").collect()] == [(5, "x"), (6, "y"), (None, None)]


def test_streamed_state_is_merged_and_tidied(spark, tmp_path):
    v = preagg.View("v", preagg.Spec("t", ("k",), (("count", "*", "n"), ("sum", "x", "s"))))
    schema = "k int, x int"
    for k in range(7):
        spark.createDataFrame([(k % 2, k), (5, 1)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    ingest.incremental_view(stream, v, f"{tmp_path}/state", f"{tmp_path}/ck", every=3).awaitTermination()
    v.data = ingest.view_state(spark, v, f"{tmp_path}/state")
    assert sorted(map(tuple, v.run(v.spec).collect())) == [(0, 4, 12), (1, 3, 9), (5, 7, 7)]
    assert sorted(p.name for p in (tmp_path / "state").iterdir()) == ["6", "whole-5"]
