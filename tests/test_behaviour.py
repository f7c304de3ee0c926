"""Behavioural operators against plain Python models, on random timelines with ties, null users and window boundaries."""

import random

import pytest
from pyspark.sql import functions as F

from fathom.operators import cohort, flatjson, funnel, paths, sessions

KINDS = ["a", "b", "c", "d"]
SCHEMA = "event_id long, t long, user_id long, event_type string"


@pytest.fixture(scope="module")
def timeline(spark):
    r = random.Random(5)
    rows = [(i, 1_000 * r.randrange(0, 400), r.choice([None, *range(12)]), r.choice(KINDS)) for i in range(900)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds("t")).cache()
    users = {}
    for i, t, u, e in sorted(rows, key=lambda x: (x[1], x[0])):
        if u is not None:
            users.setdefault(u, []).append((t, i, e))
    return df, users


def _anchored(users, steps, window, best):
    out = [0] * len(steps)
    for line in users.values():
        k, t0, m = 0, 0, 0
        for t, _, e in line:
            if k < len(steps) and e == steps[k]:
                if k == 0:
                    k, t0, m = 1, t, max(m, 1) if best else 1
                elif t - t0 <= window:
                    k += 1
                    m = max(m, k) if best else k
                else:
                    k, t0 = 1, t
        for i in range(m):
            out[i] += 1
    return out


@pytest.mark.parametrize("best", [False, True])
@pytest.mark.parametrize("steps,window", [(["a", "b", "c"], 9000), (["a", "a", "d"], 4000), (["b"], 10)])
def test_anchored(timeline, steps, window, best):
    df, users = timeline
    got = {r.step: r.users for r in funnel.funnel_anchored(df, steps, window, best=best).collect()}
    assert [got[i + 1] for i in range(len(steps))] == _anchored(users, steps, window, best)


def test_stepwise(timeline):
    df, users = timeline
    steps, window, want = ["a", "b", "c"], 3000, [0, 0, 0]
    for line in users.values():
        at = [None] * 3
        for t, _, e in line:
            for i, s in enumerate(steps):
                if e == s and (i == 0 or (at[i - 1] is not None and 0 <= t - at[i - 1] <= window)):
                    at[i] = t
        for i in range(3):
            want[i] += at[i] is not None
    got = sorted(funnel.funnel_stepwise(df, steps, window).collect(), key=lambda r: r.step)
    assert [r.users for r in got] == want
    assert got[0].conversion == 1.0


def test_funnel_pinned(spark):
    """100 000 closed-form events: 1000 users, of whom 600 and 200 go on."""
    names = F.when((F.col("e") == 0) & (F.col("u") < 300), "signup").when((F.col("e") == 10) & (F.col("u") < 800), "search").when((F.col("e") == 20) & (F.col("u") < 600), "add_to_cart").when((F.col("e") == 30) & (F.col("u") < 400), "checkout").when((F.col("e") == 40) & (F.col("u") < 200), "purchase").otherwise("page_view")
    df = spark.range(100_000).select(F.col("id").alias("event_id"), F.floor(F.col("id") / 100).alias("u"), (F.col("id") % 100).alias("e"))
    df = df.select("event_id", F.col("u").alias("user_id"), names.alias("event_type"), F.timestamp_seconds(F.lit(1772323200) + F.col("u") * 3600 + F.col("e") * 60).alias("ts"))
    assert df.where("event_type = 'page_view'").count() == 97_700
    assert [r.users for r in funnel.funnel_anchored(df, ["page_view", "add_to_cart", "purchase"]).orderBy("step").collect()] == [1000, 600, 200]
    assert [r.users for r in funnel.funnel_anchored(df, ["signup", "purchase"]).orderBy("step").collect()] == [300, 200]
    assert cohort.first_return(df, "signup", "purchase").agg(F.sum("cohort_size")).first()[0] == 300


def test_funnel_by_and_empty(timeline):
    df, users = timeline
    by = funnel.funnel_anchored(df.withColumn("half", F.col("user_id") % 2), ["a", "b"], 5000, by=["half"])
    both = by.groupBy("step").agg(F.sum("users").alias("n")).orderBy("step").collect()
    assert [r.n for r in both] == _anchored(users, ["a", "b"], 5000, False)
    assert [r.users for r in funnel.funnel_anchored(df.limit(0), ["a", "b"]).orderBy("step").collect()] == [0, 0]


@pytest.mark.parametrize("start,end,depth", [(None, None, 3), ("a", None, 3), ("a", "c", 5), (None, "d", 4)])
def test_session_paths(timeline, start, end, depth):
    df, users = timeline
    want = {}
    for line in users.values():
        path, last, all_of = [], None, []
        for t, _, e in line:
            if path and t - last > 8000:
                all_of.append(path)
                path = []
            if not path and start is not None and e != start:
                continue
            path, last = [*path, e], t
            if len(path) >= depth or e == end:
                all_of.append(path)
                path = []
        for p in [*all_of, path]:
            if len(p) >= 2:
                want[" => ".join(p)] = want.get(" => ".join(p), 0) + 1
    got = {r.path: r["count"] for r in paths.session_paths(df, start, end, depth, 8000, top=10_000).collect()}
    assert got == want


def test_session_boundary(spark):
    rows = [(1, 0, 7, "a"), (2, 1800, 7, "b"), (3, 3601, 7, "c"), (4, 0, None, "a")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds("t"))
    s = sessions.sessionize(df, 1800).orderBy("session_seq").collect()
    assert [r.event_sequence for r in s] == [["a", "b"], ["c"]]
    assert [r.duration_secs for r in s] == [1800, 0]
    assert s[0].session_id == sessions.sessionize(df, 1800).where("session_seq = 1").first().session_id


def test_session_refresh_equals_rebuild(timeline):
    df, _ = timeline
    old, new = df.where("event_id % 3 <> 0"), df.where("event_id % 3 = 0 and user_id < 4")
    whole = sessions.sessionize(old.union(new), 5000).select("session_id", "session_event_count")
    step = sessions.refresh(sessions.sessionize(old, 5000), old, new, 5000).select("session_id", "session_event_count")
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, step.collect()))


def test_cohort_metrics(timeline):
    df, _ = timeline
    m = cohort.retention_matrix(df, "a", "b", "DAY", 2).collect()
    assert all(r.users <= r.cohort_size for r in m)
    assert {r.period for r in m} == {0, 1, 2}
    assert cohort.retention_matrix(df, "a", "b", "WEEK", 1, "USER_COUNT").count() > 0
    with pytest.raises(ValueError):
        cohort.retention_matrix(df, "a", "b", metric="X")


def test_flatjson(spark):
    rows = [('{"p":"x","price":100}',), ('{"p":"y","price":1.5,"b":true}',), ('{"p":"z","n":{"a":1}}',), ("broken",), (None,)]
    df = spark.createDataFrame(rows, "j string")
    got = {r.key: (r.occurrences, r.type) for r in flatjson.key_stats(df, "j").collect()}
    assert got == {"p": (3, "string"), "price": (2, "float64"), "b": (1, "bool"), "n": (1, "string")}
    assert flatjson.promote(df, "j", 0.6).columns == ["j", "p"]
