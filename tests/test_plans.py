"""Layout routing, pre-aggregates, statements, sources and streams."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.operators import funnel
from fathom.plans import preagg
from fathom.plans.registry import Registry, State, pattern
from fathom.plans.statements import Engine, UnsupportedStatement, seconds
from fathom.sources import tables
from fathom.streaming import ingest

from .conftest import SMALL


def test_routed_equals_unrouted(spark):
    e = tables.events(spark, SMALL)
    r = Registry()
    r.create("s", "Events", e, timeout_seconds=21600)
    assert r.decide("events").use == "sessions"
    a = funnel.funnel_anchored(r.events("events", e), ["view", "click", "purchase"], 43200)
    b = funnel.funnel_anchored(e, ["view", "click", "purchase"], 43200)
    assert sorted(a.collect()) == sorted(b.collect())


def test_routing_rules(spark):
    e = tables.events(spark, SMALL)
    r = Registry()
    with pytest.warns(UserWarning):
        assert r.decide("events").use == "events"
    r.create("s", "events", e, timeout_seconds=60)
    assert r.decide("events", timeout_seconds=61).use == "events"
    assert r.decide("events", user_key="device").use == "events"
    assert r.decide("events", route="never").use == "events"
    r.changed("EVENTS")
    assert r.layouts["s"].state is State.STALE and r.decide("events").use == "events"
    r.refresh("s", e, e.limit(0))
    assert r.decide("events").use == "sessions"
    assert pattern({"FUNNEL_COUNT"}, set(), set()) == "behavioural"
    assert pattern(set(), {"session_id", "value"}, {"value"}) == "hybrid"
    assert pattern(set(), {"value"}, {"value"}) == "event"


def test_preagg_matching(spark):
    e = tables.events(spark, SMALL)
    v = preagg.View("v", preagg.Spec("events", ("event_type", "user_id"), (("count", "*", "n"), ("sum", "value", "s"), ("count_distinct", "event_id", "d"), ("approx_distinct", "event_id", "h")))).refresh(e)
    q = preagg.Spec("events", ("event_type",), (("count", "*", "n"),))
    got, used = preagg.rewrite(q, [v], e)
    assert used == "v" and sorted(got.collect()) == sorted(q.run(e).collect())
    assert v.answers(preagg.Spec("events", ("event_type",), (("count_distinct", "event_id", "d"),)))
    assert v.answers(preagg.Spec("events", ("ts",), (("count", "*", "n"),)))
    assert v.answers(preagg.Spec("events", ("event_type",), (("max", "value", "x"),)))
    assert v.answers(preagg.Spec("events", ("event_type",), (("count", "*", "n"),), (("value", "value > 0"),)))
    step = preagg.View("w", v.spec)
    step.add(e.where("event_id % 2 = 0")).add(e.where("event_id % 2 = 1"))
    tidy = lambda x: sorted(x.run(v.spec).withColumn("s", F.round("s", 6)).collect())
    assert tidy(step) == tidy(v)


def test_statements(spark):
    tables.events(spark, SMALL).createOrReplaceTempView("ev")
    x = Engine(spark)
    x.sql("CREATE SESSION MATERIALIZED VIEW s1 FROM ev USER KEY user_id SESSION TIMEOUT 6 HOURS REFRESH INCREMENTAL")
    assert x.registry.layouts["s1"].timeout_seconds == 21600
    assert x.sql("EXPLAIN BEHAVIORAL ROUTING ev").first().decision == "sessions"
    got = x.sql("SELECT FUNNEL_COUNT(user_key => user_id, event_col => event_type, time_col => ts, steps => ['view', 'click'], time_window => INTERVAL 12 HOUR) FROM ev WHERE value > 1")
    want = funnel.funnel_anchored(tables.events(spark, SMALL).where("value > 1"), ["view", "click"], 43200)
    assert sorted(got.collect()) == sorted(want.collect())
    assert x.sql("SELECT * FROM PATH_ANALYSIS(user_key => user_id, event_col => event_type, time_col => ts, path_length => 2) FROM ev").columns == ["path", "count", "percentage"]
    assert x.sql("SELECT COHORT_ANALYSIS(entry_event => 'signup', return_event => 'purchase') FROM ev").count() > 0
    x.sql("CREATE MATERIALIZED VIEW m AS SELECT event_type, COUNT(*) AS n, COUNT(DISTINCT user_id) AS u FROM ev GROUP BY event_type")
    assert x.views["m"].spec.aggs == (("count", "*", "n"), ("count_distinct", "user_id", "u"))
    x.sql("REFRESH MATERIALIZED VIEW m")
    x.sql("CREATE CUBE IF NOT EXISTS cube1 (id BIGINT NOT NULL, d DECIMAL(10,2), j JSON, t DATETIME) ORDER BY (id) DISTRIBUTED BY HASH(id) BUCKETS 4")
    assert dict(spark.table("cube1").dtypes) == {"id": "bigint", "d": "decimal(10,2)", "j": "string", "t": "timestamp"}
    with pytest.raises(ValueError):
        x.sql("CREATE CUBE c2 (j JSON) ORDER BY (j)")
    x.sql("DROP CUBE IF EXISTS cube1")
    with pytest.raises(UnsupportedStatement):
        x.sql("UPDATE ev SET value = 1")
    assert x.sql("SELECT 1 AS one").first().one == 1
    assert x.cached(spark.range(3)) is x.cached(spark.range(3))
    assert seconds("INTERVAL 2 weeks") == 1209600
    with pytest.raises(ValueError):
        seconds("3 parsecs")


def test_pushdown(spark):
    tables.register(spark, SMALL, ("lineitem",))
    plan = spark.sql("SELECT l_orderkey FROM lineitem WHERE l_quantity > 49")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,49.0)" in plan and "l_comment" not in plan and "l_extendedprice" not in plan


def test_bucketed_join_has_no_exchange(spark):
    for name, key in (("orders", "o_custkey"), ("customer", "c_custkey")):
        tables.write_bucketed(tables.read(spark, SMALL, name), f"b_{name}", key, 4)
    j = spark.table("b_orders").hint("merge").join(spark.table("b_customer"), F.col("o_custkey") == F.col("c_custkey"))
    assert "Exchange" not in j._jdf.queryExecution().executedPlan().toString()
    for name in ("orders", "customer"):
        spark.sql(f"DROP TABLE b_{name}")


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_formats(spark, tmp_path, fmt):
    df = tables.read(spark, SMALL, "nation")
    df.write.format(fmt).option("header", "true").save(f"{tmp_path}/x")
    got = tables.external(spark, fmt, f"{tmp_path}/x", df.schema, header="true")
    assert sorted(got.collect()) == sorted(df.collect())
    with pytest.raises(ValueError):
        tables.external(spark, "xls", "x")


def test_partitions(spark, tmp_path):
    e = tables.events(spark, SMALL)
    tables.write_partitioned(e, f"{tmp_path}/p", "ts", "MONTH", bloom_on="user_id")
    assert {r.p for r in spark.read.parquet(f"{tmp_path}/p").select("p").distinct().collect()} == {"p_2024_01"}


def test_streams(spark, tmp_path):
    lines = tmp_path / "in"
    lines.mkdir()
    good = ['{"event_id":%d,"ts":"2024-01-01T00:%02d:00Z","user_id":1,"event_type":"view","value":1.0}' % (i, i) for i in range(5)]
    (lines / "a.json").write_text("\n".join([*good, good[0], "not json", '{"event_id":9}']) + "\n")
    a, b = ingest.routine_load(ingest.files(spark, str(lines)), f"{tmp_path}/t", f"{tmp_path}/dead", f"{tmp_path}/ck")
    a.awaitTermination()
    b.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/t").count() == 5
    assert spark.read.text(f"{tmp_path}/dead").count() == 2
    v = preagg.View("v", preagg.Spec("t", ("event_type",), (("count", "*", "n"), ("avg", "value", "m"))))
    stream = spark.readStream.schema(ingest.EVENTS).parquet(f"{tmp_path}/t")
    ingest.incremental_view(stream, v, f"{tmp_path}/state", f"{tmp_path}/ck2").awaitTermination()
    v.data = spark.read.parquet(f"{tmp_path}/state/0")
    assert [tuple(r) for r in v.run(v.spec).collect()] == [("view", 5, 1.0)]


def test_stream_sessions(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:30:00"), (1, "2024-01-01 01:00:01"), (2, "2024-01-03 00:00:00")]
    spark.createDataFrame(rows, "user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/e")
    schema = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("ts", T.TimestampType())])
    q = ingest.stream_sessions(spark.readStream.schema(schema).parquet(f"{tmp_path}/e")).writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.session_event_count for r in spark.table("closed").collect()) == [1, 2]


def test_dead_letters_and_ttl(spark):
    good, bad = tables.json_lines(spark.createDataFrame([('{"a":1}',), ("x",), ("{}",)], "value string"), T.StructType([T.StructField("a", T.LongType(), False)]))
    assert good.count() == 1 and bad.count() == 2
    e = spark.createDataFrame([("2024-01-01 00:00:00",), ("2023-12-31 23:59:59",), (None,)], "s string").select(F.col("s").cast("timestamp").alias("ts"))
    assert tables.live(e, "ts", "30 days", "2024-01-31 00:00:00").count() == 2
