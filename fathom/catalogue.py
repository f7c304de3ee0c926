"""All queries of the library and their DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import relational
from .functions import mysql
from .operators import cohort, flatjson, funnel, paths, sessions
from .plans import preagg
from .plans.registry import Registry, fingerprint
from .plans.statements import Engine, column_stats
from .sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _sql(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        used = [t for t in tables.TABLES if t in text]
        tables.register(spark, sf_dir, tuple(used))
        return spark.sql(text)

    return run


for _name, _text in relational.BOTH.items():
    QUERIES[_name], ORACLES[_name] = _sql(_text), _text
for _name, (_spark, _duck) in relational.EACH.items():
    QUERIES[_name], ORACLES[_name] = _sql(_spark), _duck


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


HOURS = 3600


def _anchored_sql(steps: list[str], window: int, best: bool = False) -> str:
    """A walk over each user's step events by row number, as recursive SQL."""
    at = " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(steps))
    names = ", ".join(f"({i + 1}, '{s}')" for i, s in enumerate(steps))
    hit = f"w.k < {len(steps)} AND e.e = CASE w.k {at} END"
    late = f"e.t - w.t0 > {window * 1_000_000}"
    m = "greatest(w.m, 1)" if best else "1"
    m2 = "greatest(w.m, w.k + 1)" if best else "w.k + 1"
    inside = ", ".join(f"'{s}'" for s in set(steps))
    return f"""
WITH RECURSIVE e AS (SELECT user_id AS u, epoch_us(ts) AS t, event_type AS e, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE event_type IN ({inside})),
w AS (SELECT DISTINCT u, 0::BIGINT AS rn, 0 AS k, 0::BIGINT AS t0, 0 AS m FROM e
  UNION ALL
  SELECT w.u, e.rn, CASE WHEN NOT ({hit}) THEN w.k WHEN w.k = 0 OR {late} THEN 1 ELSE w.k + 1 END,
    CASE WHEN ({hit}) AND (w.k = 0 OR {late}) THEN e.t ELSE w.t0 END,
    CASE WHEN NOT ({hit}) THEN w.m WHEN w.k = 0 THEN {m} WHEN {late} THEN w.m ELSE {m2} END
  FROM w JOIN e ON e.u = w.u AND e.rn = w.rn + 1),
last AS (SELECT u, arg_max(m, rn) AS m FROM w GROUP BY u)
SELECT s.step::INTEGER AS step, s.step_name, (SELECT count(*) FROM last WHERE m >= s.step) AS users FROM (VALUES {names}) AS s(step, step_name)"""


@query(_anchored_sql(["view", "click", "purchase"], 6 * HOURS))
def funnel_anchored(spark, sf_dir):
    return funnel.funnel_anchored(tables.events(spark, sf_dir), ["view", "click", "purchase"], 6 * HOURS)


@query(_anchored_sql(["signup", "view", "click", "purchase"], 24 * HOURS))
def funnel_anchored_four(spark, sf_dir):
    return funnel.funnel_anchored(tables.events(spark, sf_dir), ["signup", "view", "click", "purchase"], 24 * HOURS)


@query(_anchored_sql(["signup", "view", "click", "purchase"], 24 * HOURS, best=True))
def funnel_best_progress(spark, sf_dir):
    return funnel.funnel_anchored(tables.events(spark, sf_dir), ["signup", "view", "click", "purchase"], 24 * HOURS, best=True)


@query(_anchored_sql(["view", "view", "purchase"], 3 * HOURS))
def funnel_repeated_step(spark, sf_dir):
    return funnel.funnel_anchored(tables.events(spark, sf_dir), ["view", "view", "purchase"], 3 * HOURS)


def _stepwise_sql(steps: list[str], window: int) -> str:
    w, n = window * 1_000_000, len(steps)
    cur: list[str] = []
    for i, s in enumerate(steps):
        ok = f"e.e = '{s}'" if i == 0 else f"e.e = '{s}' AND ({cur[i - 1]}) IS NOT NULL AND e.t - ({cur[i - 1]}) BETWEEN 0 AND {w}"
        cur.append(f"CASE WHEN {ok} THEN e.t ELSE w.t{i} END")
    names = ", ".join(f"({i + 1}, '{s}')" for i, s in enumerate(steps))
    inside = ", ".join(f"'{s}'" for s in set(steps))
    most = " + ".join(f"(t{i} IS NOT NULL)::INT" for i in range(n))
    return f"""
WITH RECURSIVE e AS (SELECT user_id AS u, epoch_us(ts) AS t, event_type AS e, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE event_type IN ({inside})),
w AS (SELECT DISTINCT u, 0::BIGINT AS rn, {", ".join(f"NULL::BIGINT AS t{i}" for i in range(n))} FROM e
  UNION ALL SELECT w.u, e.rn, {", ".join(cur)} FROM w JOIN e ON e.u = w.u AND e.rn = w.rn + 1),
last AS (SELECT u, arg_max({most}, rn) AS m FROM w GROUP BY u),
c AS (SELECT s.step::INTEGER AS step, s.step_name, (SELECT count(*) FROM last WHERE m >= s.step) AS users FROM (VALUES {names}) AS s(step, step_name))
SELECT step, step_name, users, round(users / nullif((SELECT users FROM c WHERE step = 1), 0), 6) AS conversion FROM c"""


@query(_stepwise_sql(["view", "click", "purchase"], 6 * HOURS))
def funnel_stepwise(spark, sf_dir):
    return funnel.funnel_stepwise(tables.events(spark, sf_dir), ["view", "click", "purchase"], 6 * HOURS)


@query(_anchored_sql(["view", "click", "purchase"], 12 * HOURS).replace("event_type IN ('", "value >= 0 AND event_type IN ('"))
def funnel_predicate_steps(spark, sf_dir):
    """Steps as conditions, with a WHERE."""
    df = tables.events(spark, sf_dir).where("value >= 0")
    return funnel.funnel_anchored(df, [F.col("event_type") == s for s in ("view", "click", "purchase")], 12 * HOURS, names=["view", "click", "purchase"])


@query(
    """WITH a AS (SELECT user_id, epoch_us(ts) AS t, event_type FROM events), f AS (SELECT user_id, min(t) AS t0 FROM a WHERE event_type = 'view' GROUP BY 1),
s AS (SELECT * FROM (VALUES (1, 'view'), (2, 'click'), (3, 'purchase')) AS v(step, step_name))
SELECT step::INTEGER AS step, step_name, count(DISTINCT a.user_id) AS users FROM s JOIN a ON a.event_type = s.step_name JOIN f USING (user_id) WHERE a.t BETWEEN f.t0 AND f.t0 + 21600000000 GROUP BY 1, 2"""
)
def funnel_tolerant(spark, sf_dir):
    return funnel.funnel_tolerant(tables.events(spark, sf_dir), ["view", "click", "purchase"], 6 * HOURS)


@query(
    """WITH e AS (SELECT user_id AS u, epoch_us(ts) AS t, event_type AS e FROM events), s AS (SELECT u, min(t) AS t0 FROM e WHERE e = 'signup' GROUP BY u),
r AS (SELECT s.u, s.t0, min(e.t) AS t1 FROM s LEFT JOIN e ON e.u = s.u AND e.e = 'purchase' AND e.t > s.t0 GROUP BY 1, 2),
d AS (SELECT t0 // 604800000000 AS week, (t1 - t0) // 86400000000 AS days FROM r)
SELECT 'Week ' || week AS cohort_week, count(*) AS cohort_size, round(count(*) FILTER (WHERE days <= 7) / count(*), 6) AS day_7_retention, round(count(*) FILTER (WHERE days <= 14) / count(*), 6) AS day_14_retention, round(count(*) FILTER (WHERE days <= 30) / count(*), 6) AS day_30_retention FROM d GROUP BY week"""
)
def cohort_first_return(spark, sf_dir):
    return cohort.first_return(tables.events(spark, sf_dir), "signup", "purchase")


def _matrix_sql(span: int, periods: int) -> str:
    s = span * 86_400_000_000
    return f"""
WITH e AS (SELECT user_id AS u, epoch_us(ts) AS t, event_id AS i, event_type AS e FROM events), f AS (SELECT u, min((t, i)) AS a FROM e WHERE e = 'signup' GROUP BY u),
c AS (SELECT u, a, a[1] // {s} AS cohort FROM f), z AS (SELECT cohort, count(*) AS cohort_size FROM c GROUP BY 1),
h AS (SELECT cohort, e.t // {s} - cohort AS period, count(DISTINCT e.u) AS users FROM e JOIN c USING (u) WHERE e.e = 'purchase' AND (e.t, e.i) >= a GROUP BY 1, 2)
SELECT z.cohort, cohort_size, g.period, coalesce(users, 0) AS users, round(coalesce(users, 0) / cohort_size, 6) AS value FROM z CROSS JOIN (SELECT unnest(range({periods + 1})) AS period) g LEFT JOIN h ON h.cohort = z.cohort AND h.period = g.period"""


@query(_matrix_sql(1, 7))
def cohort_matrix_day(spark, sf_dir):
    return cohort.retention_matrix(tables.events(spark, sf_dir), "signup", "purchase", "DAY", 7)


@query(_matrix_sql(7, 4))
def cohort_matrix_week(spark, sf_dir):
    return cohort.retention_matrix(tables.events(spark, sf_dir), "signup", "purchase", "WEEK", 4)


def _ngram_sql(n: int, top: int | None) -> str:
    leads = ", ".join(f"lead(event_type, {k}) OVER w AS s{k}" for k in range(1, n))
    path = " || ' => ' || ".join(["event_type", *(f"s{k}" for k in range(1, n))])
    return f"""WITH g AS (SELECT user_id, event_type, {leads} FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
p AS (SELECT {path} AS path, user_id FROM g WHERE s{n - 1} IS NOT NULL)
SELECT path, count(*) AS count, count(DISTINCT user_id) AS user_count, round(count(*) / (SELECT count(*) FROM p) * 100, 6) AS percentage FROM p GROUP BY path ORDER BY count DESC, path""" + (f" LIMIT {top}" if top else "")


@query(_ngram_sql(2, None))
def path_bigram(spark, sf_dir):
    return paths.ngrams(tables.events(spark, sf_dir), 2, None)


@query(_ngram_sql(3, 20))
def path_trigram_top20(spark, sf_dir):
    return paths.ngrams(tables.events(spark, sf_dir), 3, 20)


@query(
    """WITH a AS (SELECT user_id AS u, epoch_us(ts) AS t, event_id AS i, event_type AS e FROM events), b AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY u ORDER BY t, i) > 43200000000 THEN 1 ELSE 0 END AS f FROM a),
c AS (SELECT *, sum(f) OVER (PARTITION BY u ORDER BY t, i ROWS UNBOUNDED PRECEDING) AS s FROM b), d AS (SELECT *, (row_number() OVER (PARTITION BY u, s ORDER BY t, i) - 1) // 3 AS k FROM c),
p AS (SELECT string_agg(e, ' => ' ORDER BY t, i) AS path FROM d GROUP BY u, s, k HAVING count(*) >= 2), q AS (SELECT path, count(*) AS count FROM p GROUP BY path)
SELECT (row_number() OVER (ORDER BY count DESC, path))::INTEGER AS rank, path, count FROM q ORDER BY count DESC, path LIMIT 20"""
)
def session_paths_depth(spark, sf_dir):
    return paths.session_paths(tables.events(spark, sf_dir), max_depth=3, gap_seconds=12 * HOURS)


def _walk_sql(start: str, end: str, depth: int, gap: int) -> str:
    """session_paths with a start and an end, as a walk over each user's events by row number."""
    n = f"CASE WHEN w.n > 0 AND e.t - w.l > {gap * 1_000_000} THEN 0 ELSE w.n END"
    take = f"(({n}) > 0 OR e.e = '{start}')"
    return f"""
WITH RECURSIVE e AS (SELECT user_id AS u, epoch_us(ts) AS t, event_type AS e, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
w AS (SELECT DISTINCT u, 0::BIGINT AS rn, 0 AS n, 0::BIGINT AS l, 0 AS p, false AS k, NULL::VARCHAR AS e FROM e
  UNION ALL
  SELECT w.u, e.rn, CASE WHEN NOT {take} THEN ({n}) WHEN ({n}) + 1 >= {depth} OR e.e = '{end}' THEN 0 ELSE ({n}) + 1 END,
    CASE WHEN {take} THEN e.t ELSE w.l END, CASE WHEN {take} AND ({n}) = 0 THEN w.p + 1 ELSE w.p END, {take}, e.e
  FROM w JOIN e ON e.u = w.u AND e.rn = w.rn + 1),
p AS (SELECT string_agg(e, ' => ' ORDER BY rn) AS path FROM w WHERE k GROUP BY u, p HAVING count(*) >= 2), q AS (SELECT path, count(*) AS count FROM p GROUP BY path)
SELECT (row_number() OVER (ORDER BY count DESC, path))::INTEGER AS rank, path, count FROM q ORDER BY count DESC, path LIMIT 20"""


@query(_walk_sql("view", "purchase", 4, 12 * HOURS))
def session_paths_start_end(spark, sf_dir):
    return paths.session_paths(tables.events(spark, sf_dir), start="view", end="purchase", max_depth=4, gap_seconds=12 * HOURS)


def _session_sql(gap: int) -> str:
    return f"""WITH a AS (SELECT user_id AS u, epoch_us(ts) AS t, event_id AS i, event_type AS e FROM events), b AS (SELECT *, CASE WHEN t - lag(t) OVER w <= {gap * 1_000_000} THEN 0 ELSE 1 END AS f FROM a WINDOW w AS (PARTITION BY u ORDER BY t, i)),
c AS (SELECT *, sum(f) OVER (PARTITION BY u ORDER BY t, i ROWS UNBOUNDED PRECEDING) AS s FROM b)
SELECT sha256(u || ':' || min(t)) AS session_id, u AS user_key, s::BIGINT AS session_seq, count(*) AS session_event_count, (max(t) - min(t)) // 1000000 AS duration_secs, min(t) AS start_us, string_agg(e, ',' ORDER BY t, i) AS events FROM c GROUP BY u, s"""


def _session_rows(spark, sf_dir, gap):
    s = sessions.sessionize(tables.events(spark, sf_dir), gap)
    return s.select("session_id", "user_key", "session_seq", "session_event_count", "duration_secs", F.unix_micros("session_start").alias("start_us"), F.concat_ws(",", "event_sequence").alias("events"))


@query(_session_sql(6 * HOURS))
def sessionize_6h(spark, sf_dir):
    return _session_rows(spark, sf_dir, 6 * HOURS)


@query(_session_sql(1800))
def sessionize_30m(spark, sf_dir):
    return _session_rows(spark, sf_dir, 1800)


@query(f"SELECT sum(session_event_count)::BIGINT AS events, count(*) AS sessions, count(DISTINCT user_key) AS users, round(avg(session_event_count), 6) AS avg_events FROM ({_session_sql(6 * HOURS)})")
def session_stats(spark, sf_dir):
    return sessions.session_stats(sessions.sessionize(tables.events(spark, sf_dir), 6 * HOURS))


@query(
    """WITH a AS (SELECT user_id AS u, epoch_us(ts) AS t, event_id FROM events), b AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY u ORDER BY t, event_id) <= 21600000000 THEN 0 ELSE 1 END AS f FROM a),
c AS (SELECT *, sum(f) OVER (PARTITION BY u ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS s FROM b)
SELECT event_id, s::BIGINT AS session_seq, s = 1 AS is_new_user, (max(t) OVER (PARTITION BY u, s) - min(t) OVER (PARTITION BY u, s)) // 1000000 AS session_duration_secs FROM c"""
)
def event_sessions(spark, sf_dir):
    return sessions.with_sessions(tables.events(spark, sf_dir), 6 * HOURS).select("event_id", "session_seq", "is_new_user", "session_duration_secs")


_STORED: dict[tuple, object] = {}


def _kept(spark, sf_dir, what: str, build):
    """What a session has stored for a folder of tables: built when first asked for, and anew when the session or the files change."""
    now = (spark.sparkContext.applicationId, sf_dir, what)
    made_of = fingerprint(tables.read(spark, sf_dir, "events"))
    if now not in _STORED or _STORED[now][0] != made_of:
        _STORED[now] = (made_of, build())
    return _STORED[now][1]


def _routed(spark, sf_dir):
    """The events behind a stored session table, where the registry allows it."""
    events = tables.events(spark, sf_dir)

    def build():
        r = Registry()
        name = f"events_sessions_{uuid.uuid4().hex[:8]}"
        r.create(name, "events", events, timeout_seconds=6 * HOURS, table=name)
        return r

    return _kept(spark, sf_dir, "sessions", build).events("events", events)


@query(ORACLES["funnel_anchored"])
def funnel_via_session_table(spark, sf_dir):
    return funnel.funnel_anchored(_routed(spark, sf_dir), ["view", "click", "purchase"], 6 * HOURS)


@query(ORACLES["path_trigram_top20"])
def path_via_session_table(spark, sf_dir):
    return paths.ngrams(_routed(spark, sf_dir), 3, 20)


_DAILY = preagg.Spec("events", ("day", "event_type"), (("count", "*", "n"), ("sum", "value", "total"), ("avg", "value", "mean"), ("min", "value", "lo"), ("max", "value", "hi")))
_BY_TYPE = preagg.Spec("events", ("event_type",), (("count", "*", "n"), ("sum", "value", "total"), ("avg", "value", "mean"), ("min", "value", "lo"), ("max", "value", "hi")), (("day", "day >= '2024-01-05'"),))
_BY_TYPE_SQL = "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total, round(avg(value), 4) AS mean, min(value) AS lo, max(value) AS hi FROM events WHERE ts >= TIMESTAMP '2024-01-05' GROUP BY event_type"


def _with_day(spark, sf_dir):
    return tables.events(spark, sf_dir).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))


def _tidy(df: DataFrame) -> DataFrame:
    return df.withColumn("total", F.round("total", 2)).withColumn("mean", F.round("mean", 4))


@query(_BY_TYPE_SQL)
def preagg_daily_rewrite(spark, sf_dir):
    """The query from a stored daily pre-aggregate."""
    df = _with_day(spark, sf_dir)

    def build():
        v, name = preagg.View("daily", _DAILY), f"daily_{uuid.uuid4().hex[:8]}"
        v.state(df).write.saveAsTable(name)
        v.data = spark.table(name)
        return v

    return _tidy(preagg.rewrite(_BY_TYPE, [_kept(spark, sf_dir, "daily", build)], df)[0])


def _engine(spark, sf_dir) -> Engine:
    """A statement engine over a copy of the events that is a table of its own."""
    name = f"ev_{uuid.uuid4().hex[:8]}"
    tables.events(spark, sf_dir).write.saveAsTable(name)
    x = Engine(spark)
    x.table = name
    return x


@query("SELECT date_trunc('day', ts)::DATE::VARCHAR AS day, event_type, count(*) AS n, round(sum(value * 2), 2) AS twice, max(value) AS hi, count(DISTINCT user_id) AS users FROM events WHERE value >= 1 GROUP BY 1, 2")
def statement_preagg(spark, sf_dir):
    """CREATE MATERIALIZED VIEW with expressions, a condition and an unnamed aggregate; the same query is then answered from it."""
    x = _engine(spark, sf_dir)
    body = f"SELECT CAST(CAST(ts AS DATE) AS STRING) AS day, event_type, COUNT(*) AS n, SUM(value * 2) AS twice, MAX(value), COUNT(DISTINCT user_id) AS users FROM {x.table} WHERE value >= 1 GROUP BY day, event_type"
    x.sql(f"CREATE MATERIALIZED VIEW {x.table}_mv AS {body}")
    got = x.sql(body)
    assert x.last_route == f"{x.table}_mv"
    return got.withColumnRenamed("max(value)", "hi").withColumn("twice", F.round("twice", 2))


@query("SELECT event_type, (count(*) + (SELECT count(*) FROM events WHERE event_type = e.event_type AND value > 50))::BIGINT AS n FROM events e GROUP BY event_type")
def statement_preagg_after_insert(spark, sf_dir):
    """A pre-aggregate is passed over once its source has more rows, and answers again after a refresh."""
    x = _engine(spark, sf_dir)
    q = f"SELECT event_type, COUNT(*) AS n FROM {x.table} GROUP BY event_type"
    x.sql(f"CREATE MATERIALIZED VIEW {x.table}_mv AS {q}")
    x.sql(f"INSERT INTO {x.table} SELECT * FROM {x.table} WHERE value > 50")
    x.last_route = ""
    stale = x.sql(q)
    assert x.last_route == ""
    x.sql(f"REFRESH MATERIALIZED VIEW {x.table}_mv")
    fresh = x.sql(q)
    assert x.last_route == f"{x.table}_mv"
    return stale.unionByName(fresh).distinct()


@query(_anchored_sql(["view", "click", "purchase"], 6 * HOURS).replace("FROM events", "FROM (SELECT * FROM events WHERE event_type <> 'click' OR value > 20)"))
def statement_funnel_after_delete(spark, sf_dir):
    """FUNNEL_COUNT never answers from a session table that is older than its source."""
    x = _engine(spark, sf_dir)
    x.sql(f"CREATE SESSION MATERIALIZED VIEW {x.table}_s FROM {x.table} USER KEY user_id SESSION TIMEOUT 6 HOURS REFRESH MANUAL")
    x.sql(f"DELETE FROM {x.table} WHERE event_type = 'click' AND value <= 20")
    q = f"SELECT FUNNEL_COUNT(user_key => user_id, event_col => event_type, time_col => ts, steps => ['view', 'click', 'purchase'], time_window => INTERVAL 6 HOUR) FROM {x.table}"
    stale = x.sql(q)
    x.sql(f"REFRESH SESSION MATERIALIZED VIEW {x.table}_s")
    return stale.unionByName(x.sql(q)).distinct()


@query(f"SELECT half, list(users ORDER BY step) AS funnel FROM ({' UNION ALL '.join(f"SELECT {half} AS half, * FROM ({_anchored_sql(['view', 'click', 'purchase'], 6 * HOURS).replace('FROM events', f'FROM (SELECT * FROM events WHERE day(ts) % 2 = {half})')})" for half in (0, 1))}) GROUP BY half".replace("list(users ORDER BY step)", "string_agg(users::VARCHAR, ',' ORDER BY step)"))
def funnel_array_by_dimension(spark, sf_dir):
    """FUNNEL_COUNT as an array for each group."""
    df = tables.events(spark, sf_dir).withColumn("half", F.day("ts") % 2)
    got = funnel.funnel_count(df, ["view", "click", "purchase"], 6 * HOURS, by=["half"])
    return got.select("half", F.array_join("funnel", ",").alias("funnel"))


@query(ORACLES["cohort_first_return"].replace("e = 'signup'", "e = 'signup' AND v > 10").replace("e.e = 'purchase'", "e.e IN ('purchase', 'click')").replace("event_type AS e FROM", "event_type AS e, value AS v FROM"))
def cohort_by_conditions(spark, sf_dir):
    """Entry and return as conditions on the rows."""
    entry, back = (F.col("event_type") == "signup") & (F.col("value") > 10), F.col("event_type").isin("purchase", "click")
    return cohort.first_return(tables.events(spark, sf_dir), entry, back)


@query(
    """WITH g AS (SELECT user_id, event_type, lead(event_type, 1) OVER w AS s1, lead(event_type, 2) OVER w AS s2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
p AS (SELECT event_type || ',' || s1 || ',' || s2 AS path, user_id FROM g WHERE event_type = 'view' AND s2 = 'purchase')
SELECT path, count(*) AS count, count(DISTINCT user_id) AS user_count, round(count(*) / (SELECT count(*) FROM p) * 100, 6) AS percentage FROM p GROUP BY path"""
)
def path_entry_exit_array(spark, sf_dir):
    """Trigrams from one event to another, as arrays."""
    got = paths.ngrams(tables.events(spark, sf_dir), 3, None, entry="view", exit="purchase", as_array=True)
    return got.withColumn("path", F.array_join("path", ","))


@query("SELECT v.event_id, c.event_id AS last_click FROM (SELECT * FROM events WHERE event_type = 'view') v ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON v.user_id = c.user_id AND v.ts >= c.ts")
def as_of_join(spark, sf_dir):
    """Each view with the same user's last click."""
    e = tables.events(spark, sf_dir)
    clicks = e.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("last_click"))
    return tables.as_of(e.where("event_type = 'view'").select("event_id", "user_id", "ts"), clicks, "user_id", "ts", ["last_click"]).select("event_id", "last_click")


@query("SELECT v.event_id, count(c.event_id) AS clicks FROM (SELECT * FROM events WHERE event_type = 'view') v LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON v.user_id = c.user_id AND c.ts BETWEEN v.ts AND v.ts + INTERVAL 6 HOUR GROUP BY 1")
def interval_join(spark, sf_dir):
    """Clicks of the same user within six hours of each view: an equi-join with a range condition."""
    e = tables.events(spark, sf_dir)
    v, c = e.where("event_type = 'view'").alias("v"), e.where("event_type = 'click'").select("user_id", "ts", "event_id").alias("c")
    hit = (F.col("v.user_id") == F.col("c.user_id")) & F.col("c.ts").between(F.col("v.ts"), F.col("v.ts") + F.expr("INTERVAL 6 HOURS"))
    return v.join(c, hit, "left").groupBy("v.event_id").agg(F.count("c.event_id").alias("clicks"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS column, count(*) AS rows, count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(DISTINCT {c}) AS distinct, min({c})::VARCHAR AS low, max({c})::VARCHAR AS high FROM customer" for c in ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")))
def column_statistics(spark, sf_dir):
    return column_stats(tables.read(spark, sf_dir, "customer"), ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"], exact=True)


@query("SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer WHERE c_acctbal >= 0 OR c_acctbal IS NULL GROUP BY 1, 2")
def cube_lifecycle(spark, sf_dir):
    """A cube is created, filled, altered both ways and cleaned by statements alone."""
    x, name = Engine(spark), f"cube_{uuid.uuid4().hex[:8]}"
    tables.register(spark, sf_dir, ("customer",))
    x.sql(f"CREATE CUBE {name} (c_custkey BIGINT NOT NULL, c_mktsegment VARCHAR(20), c_nationkey INT, c_acctbal DOUBLE, since DATETIME) PARTITION BY RANGE(since) INTERVAL 1 MONTH AUTO ORDER BY (c_custkey) DISTRIBUTED BY HASH(c_custkey) BUCKETS 4 PROPERTIES ('team' = 'tests')")
    x.sql(f"INSERT INTO {name} SELECT c_custkey, c_mktsegment, c_nationkey, c_acctbal, TIMESTAMP '2024-01-01' + make_interval(0, 0, 0, CAST(c_custkey % 90 AS INT)) FROM customer")
    x.sql(f"ALTER CUBE {name} ADD COLUMN note TEXT")
    x.sql(f"ALTER CUBE {name} DROP COLUMN note")
    x.sql(f"DELETE FROM {name} WHERE c_acctbal < 0")
    return x.sql(f"SELECT c_mktsegment, c_nationkey, COUNT(*) AS n FROM {name} WHERE p IN ('p_2024_01', 'p_2024_02', 'p_2024_03') GROUP BY c_mktsegment, c_nationkey")


@query(_BY_TYPE_SQL)
def preagg_incremental(spark, sf_dir):
    df = _with_day(spark, sf_dir)
    v = preagg.View("daily", _DAILY)
    for part in range(3):
        v.add(df.where(F.col("event_id") % 3 == part))
    return _tidy(v.run(_BY_TYPE))


@query("SELECT 'k' AS key, count(*) AS occurrences, 1.0::DOUBLE AS occurrence_rate, 'int64' AS type FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def flatjson_key_stats(spark, sf_dir):
    return flatjson.key_stats(tables.events(spark, sf_dir), "props")


@query("SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total FROM events GROUP BY event_type")
def flatjson_promoted_agg(spark, sf_dir):
    return flatjson.promote(tables.events(spark, sf_dir), "props").groupBy("event_type").agg(F.sum("k").alias("total"))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY")
def ttl_filter(spark, sf_dir):
    return tables.live(tables.events(spark, sf_dir), "ts", "7 days", "2024-01-31 00:00:00").select("event_id")


@query("SELECT 'p_' || strftime(ts, '%Y_%m') AS p, count(*) AS n FROM events GROUP BY 1")
def auto_partition_month(spark, sf_dir):
    return tables.events(spark, sf_dir).groupBy(tables.partition_name("ts", "MONTH").alias("p")).agg(F.count("*").alias("n"))


@query("SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def colocated_join(spark, sf_dir):
    """Both sides dealt by the join key once; the join and what follows add no shuffle on it."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    o = tables.read(spark, sf_dir, "orders").select("o_custkey").repartition(n, "o_custkey").hint("merge")
    c = tables.read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").repartition(n, "c_custkey")
    return o.join(c, o.o_custkey == c.c_custkey).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("SELECT event_id, strftime(ts, '%d/%m/%Y') AS d, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type || '#' AS tag FROM events")
def mysql_functions(spark, sf_dir):
    return tables.events(spark, sf_dir).select("event_id", mysql.date_format("ts", "%d/%m/%Y").alias("d"), mysql.json_value("props", "$.k", "bigint").alias("k"), mysql.mysql_concat("event_type", F.lit("#"), F.lit(None).cast("string")).alias("tag"))


@query("SELECT event_type, count(DISTINCT user_id) AS users, true AS near, true AS hll_near, true AS union_near FROM events GROUP BY event_type")
def approx_distinct_users(spark, sf_dir):
    """Sketches beside the exact count, and whether they are within 10 % of it; the last is a union of sketches of days."""
    e = tables.events(spark, sf_dir)
    near = lambda x: F.abs(x - F.col("users")) <= 0.1 * F.col("users")
    direct = e.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))
    sketches = e.groupBy("event_type").agg(F.approx_count_distinct("user_id").alias("a"), F.hll_sketch_estimate(F.hll_sketch_agg("user_id")).alias("h"))
    days = e.groupBy("event_type", F.to_date("ts").alias("d")).agg(F.hll_sketch_agg("user_id").alias("s")).groupBy("event_type").agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("m"))
    return direct.join(sketches, "event_type").join(days, "event_type").select("event_type", "users", near(F.col("a")).alias("near"), near(F.col("h")).alias("hll_near"), near(F.col("m")).alias("union_near"))


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def bitmap_distinct_users(spark, sf_dir):
    """Exact distinct users by mergeable bitmaps: one bitmap per bucket of ids."""
    e = tables.events(spark, sf_dir)
    maps = e.groupBy("event_type", F.bitmap_bucket_number("user_id").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("user_id")).alias("m"))
    return maps.groupBy("event_type").agg(F.sum(F.bitmap_count("m")).alias("users"))


def _stream(spark, sf_dir) -> tuple[DataFrame, str]:
    path = f"{sf_dir}/events.parquet"
    reader = spark.readStream.schema(tables.read(spark, sf_dir, "events").schema)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(jpath).isDirectory():
        stream = reader.parquet(path)
    else:  # a stream watches a folder, so a single file is picked out of its own
        stream = reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp")), tables.scratch(spark, "stream")


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def stream_preagg(spark, sf_dir):
    from .streaming import ingest

    stream, base = _stream(spark, sf_dir)
    v = preagg.View("by_type", preagg.Spec("events", ("event_type",), (("count", "*", "n"), ("sum", "value", "total"))))
    ingest.incremental_view(stream, v, f"{base}/state", f"{base}/ck").awaitTermination()
    v.data = ingest.view_state(spark, v, f"{base}/state")
    return v.run(v.spec).withColumn("total", F.round("total", 2))


@query(_matrix_sql(30, 2))
def cohort_matrix_month(spark, sf_dir):
    return cohort.retention_matrix(tables.events(spark, sf_dir), "signup", "purchase", "MONTH", 2)


@query(f"SELECT cohort, cohort_size, period, users, users::DOUBLE AS value FROM ({_matrix_sql(7, 4)})")
def cohort_user_count(spark, sf_dir):
    return cohort.retention_matrix(tables.events(spark, sf_dir), "signup", "purchase", "WEEK", 4, metric="USER_COUNT")


@query(f"SELECT cohort, cohort_size, period, users, coalesce(round(users / nullif(max(users) FILTER (WHERE period = 0) OVER (PARTITION BY cohort), 0), 6), 0) AS value FROM ({_matrix_sql(7, 4)})")
def cohort_conversion_rate(spark, sf_dir):
    return cohort.retention_matrix(tables.events(spark, sf_dir), "signup", "purchase", "WEEK", 4, metric="CONVERSION_RATE")


def _within(sql: str, condition: str) -> str:
    return sql.replace("FROM events", f"FROM (SELECT * FROM events WHERE {condition})")


@query(" UNION ALL ".join(f"SELECT {half} AS half, * FROM ({_within(_stepwise_sql(['view', 'click', 'purchase'], 12 * HOURS), f'day(ts) % 2 = {half}')})" for half in (0, 1)))
def funnel_by_dimension(spark, sf_dir):
    """A funnel for each value of a dimension, in one pass."""
    df = tables.events(spark, sf_dir).withColumn("half", F.day("ts") % 2)
    return funnel.funnel_stepwise(df, ["view", "click", "purchase"], 12 * HOURS, by=["half"])


@query(
    f"""WITH a AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= {12 * HOURS * 1_000_000} THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM a),
g AS (SELECT user_id, event_type, lead(event_type) OVER (PARTITION BY user_id, s ORDER BY ts, event_id) AS s1 FROM b), p AS (SELECT event_type || ' => ' || s1 AS path, user_id FROM g WHERE s1 IS NOT NULL)
SELECT path, count(*) AS count, count(DISTINCT user_id) AS user_count, round(count(*) / (SELECT count(*) FROM p) * 100, 6) AS percentage FROM p GROUP BY path HAVING count(*) >= 3"""
)
def path_in_sessions(spark, sf_dir):
    """Bigrams that do not cross a session's end, with a minimum support."""
    df = sessions.with_sessions(tables.events(spark, sf_dir), 12 * HOURS)
    return paths.ngrams(df, 2, None, session="session_id", min_support=3)


@query(_session_sql(6 * HOURS))
def session_refresh(spark, sf_dir):
    """A session table brought up to date by a batch equals one built anew."""
    df = tables.events(spark, sf_dir)
    old, batch = df.where("event_id % 40 <> 7"), df.where("event_id % 40 = 7")
    s = sessions.refresh(sessions.sessionize(old, 6 * HOURS), old, batch, 6 * HOURS)
    return s.select("session_id", "user_key", "session_seq", "session_event_count", "duration_secs", F.unix_micros("session_start").alias("start_us"), F.concat_ws(",", "event_sequence").alias("events"))


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_counts(spark, sf_dir):
    from .streaming import ingest

    return ingest.windowed_counts(tables.events(spark, sf_dir), "6 hours").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 6 HOUR * k AS window_start, event_type, count(*) AS n FROM events CROSS JOIN (SELECT unnest([0, 1]) AS k) GROUP BY 1, 2")
def sliding_counts(spark, sf_dir):
    from .streaming import ingest

    return ingest.windowed_counts(tables.events(spark, sf_dir), "12 hours", "6 hours").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(f"SELECT user_key, start_us, session_event_count FROM ({_session_sql(6 * HOURS)})")
def window_sessions(spark, sf_dir):
    """The streaming form of sessions, over a table."""
    from .streaming import ingest

    s = ingest.stream_sessions(tables.events(spark, sf_dir), "6 hours")
    return s.select("user_key", F.unix_micros("session_start").alias("start_us"), "session_event_count")


@query("SELECT count(*) FILTER (WHERE event_id % 10 <> 0) AS good, count(*) FILTER (WHERE event_id % 10 = 0) AS dead, sum(CASE WHEN event_id % 10 <> 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END)::BIGINT AS total FROM events")
def dead_letters(spark, sf_dir):
    """JSON lines of which a tenth is cut short: typed rows to one side, the others kept as they are."""
    line = F.when(F.col("event_id") % 10 == 0, F.substring("props", 1, 4)).otherwise(F.col("props"))
    good, bad = tables.json_lines(tables.events(spark, sf_dir).select(line.alias("value")), T.StructType([T.StructField("k", T.LongType(), False)]))
    return good.agg(F.count("*").alias("good"), F.sum("k").alias("total")).crossJoin(bad.agg(F.count("*").alias("dead"))).select("good", "dead", "total")


def _external(fmt: str, **options):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = tables.scratch(spark, f"external-{fmt}")
        df = tables.read(spark, sf_dir, "customer")
        df.write.format(fmt).options(**options).save(path)
        return tables.external(spark, fmt, path, df.schema, **options).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"), F.max("c_acctbal").alias("top"))

    return run


for _fmt, _options in (("orc", {}), ("json", {}), ("csv", {"header": "true", "sep": ";"})):
    QUERIES[f"external_{_fmt}"] = _external(_fmt, **_options)
    ORACLES[f"external_{_fmt}"] = "SELECT c_mktsegment, count(*) AS n, sum(c_custkey)::BIGINT AS keys, max(c_acctbal) AS top FROM customer GROUP BY 1"


for _name in list(QUERIES):
    QUERIES[_name].__name__ = _name
