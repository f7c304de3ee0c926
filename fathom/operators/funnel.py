"""Funnels, by one shuffle on the user; no Python runs on the executors.

Events that match no step are dropped before the shuffle. Order is (ts, event_id): ties have one meaning. Rows with a null user, time or event
are ignored, as are empty tables (every step then counts 0). The stepwise and the tolerant funnel are windows, which spill, so a user may have any
number of events; the anchored one, whose walk starts again at late steps, folds an array of a user's step events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_DEFAULTS = {"user": "user_id", "ts": "ts", "event": "event_type", "event_id": "event_id"}
Step = str | Column


def _matches(step: Step, event: str) -> Column:
    return F.coalesce(F.col(event) == step if isinstance(step, str) else step, F.lit(False))


def _hits(df: DataFrame, steps: Sequence[Step], by: Sequence[str], c: dict) -> DataFrame:
    """Step events: by, __user, t (microseconds), i (id) and b, a bit set of matching steps."""
    bits = sum((F.when(_matches(s, c["event"]), 1 << i).otherwise(0) for i, s in enumerate(steps)), F.lit(0))
    rows = df.select(*by, F.col(c["user"]).alias("__user"), F.unix_micros(F.col(c["ts"]).cast("timestamp")).alias("t"), F.col(c["event_id"]).alias("i"), bits.alias("b"))
    return rows.where("__user is not null and t is not null and b <> 0")


def _timelines(df: DataFrame, steps: Sequence[Step], by: Sequence[str], c: dict) -> DataFrame:
    """One row per user (and by): `line`, its step events in order."""
    rows = _hits(df, steps, by, c)
    return rows.groupBy(*by, "__user").agg(F.array_sort(F.collect_list(F.struct("t", "i", "b"))).alias("line"))


def _hit(bits: Column, k: Column) -> Column:
    """Whether bit k, a column, is set."""
    return F.call_function("shiftright", bits, k).bitwiseAND(F.lit(1)) != 0


def _report(reached: DataFrame, steps: Sequence[Step], names: Sequence[str] | None, by: Sequence[str], conversion: bool = False) -> DataFrame:
    """(by, step, step_name, users and, if asked for, conversion) with a row for each step, reached or not; reached has `most`, the number of steps of a user."""
    spark = reached.sparkSession
    labels = list(names or [s if isinstance(s, str) else f"step_{i + 1}" for i, s in enumerate(steps)])
    if not steps:
        return spark.createDataFrame([], "step int, step_name string, users long" + ", conversion double" * conversion)
    counts = reached.groupBy(*by).agg(*[F.count_if(F.col("most") > i).alias(f"n{i}") for i in range(len(steps))])
    users = [F.coalesce(F.col(f"n{i}"), F.lit(0)) for i in range(len(steps))]
    share = lambda i: [F.round(F.coalesce(F.try_divide(users[i], users[0]), F.lit(0.0)), 6).alias("conversion")] if conversion else []
    rows = F.array(*[F.struct(F.lit(i + 1).alias("step"), F.lit(labels[i]).alias("step_name"), users[i].alias("users"), *share(i)) for i in range(len(steps))])
    return counts.select(*by, F.explode(rows).alias("r")).select(*by, "r.*")


def funnel_anchored(df: DataFrame, steps: Sequence[Step], window_seconds: int = 7 * 86400, by: Sequence[str] = (), best: bool = False, names: Sequence[str] | None = None, **columns: str) -> DataFrame:
    """Users per step, each step within the window of the first.

    A user's walk: at the expected step, within the window it advances and its progress is the new position; a step that comes
    too late restarts the walk at that event, with progress 1 for position but not for the maximum. As in the engine whose results this
    reproduces, the latest progress replaces the maximum; with best=True the furthest counts. steps are event names or boolean Columns."""
    c = _DEFAULTS | columns
    w = window_seconds * 1_000_000
    zero = F.struct(F.lit(0).alias("k"), F.lit(0).cast("long").alias("t0"), F.lit(0).alias("m"))

    def step(s: Column, x: Column) -> Column:
        hit = _hit(x["b"], s["k"]) if steps else F.lit(False)
        first, late = s["k"] == 0, x["t"] - s["t0"] > w
        k = F.when(~hit | (s["k"] >= len(steps)), s["k"]).when(first | late, 1).otherwise(s["k"] + 1)
        t0 = F.when(hit & (s["k"] < len(steps)) & (first | late), x["t"]).otherwise(s["t0"])
        m = F.when(~hit | (s["k"] >= len(steps)), s["m"]).when(first, F.greatest(s["m"], F.lit(1)) if best else F.lit(1)).when(late, s["m"]).otherwise(F.greatest(s["m"], s["k"] + 1) if best else s["k"] + 1)
        return F.struct(k.alias("k"), t0.alias("t0"), m.alias("m"))

    reached = _timelines(df, steps, by, c).select(*by, F.aggregate("line", zero, step)["m"].alias("most"))
    return _report(reached, steps, names, by)


def funnel_count(df: DataFrame, steps: Sequence[Step], window_seconds: int = 7 * 86400, by: Sequence[str] = (), **columns: str) -> DataFrame:
    """(by, funnel): the anchored funnel as one array of counts, a place for each step."""
    rows = funnel_anchored(df, steps, window_seconds, by, **columns)
    return rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "users"))), lambda x: x["users"]).alias("funnel"))


def funnel_stepwise(df: DataFrame, steps: Sequence[Step], window_seconds: int = 3600, by: Sequence[str] = (), names: Sequence[str] | None = None, **columns: str) -> DataFrame:
    """Users per step, each step within the window of the step before, with conversion (users / users of step 1).

    The first step always renews its time; step k counts if step k-1 has and 0 <= t - t(k-1) <= window, and renews its time
    too. One event may serve several steps, in order."""
    c = _DEFAULTS | columns
    w = window_seconds * 1_000_000
    rows = _hits(df, steps, by, c)
    past = Window.partitionBy(*by, "__user").orderBy("t", "i").rowsBetween(Window.unboundedPreceding, 0)
    for i in range(len(steps)):  # all over one order: one shuffle and one sort
        hit = F.col("b").bitwiseAND(F.lit(1 << i)) != 0
        if i:
            hit = hit & (F.col("t") - F.col(f"t{i - 1}")).between(0, w)
        rows = rows.withColumn(f"t{i}", F.last(F.when(hit, F.col("t")), True).over(past))
    most = sum((F.when(F.count(f"t{i}") > 0, 1).otherwise(0) for i in range(len(steps))), F.lit(0))
    return _report(rows.groupBy(*by, "__user").agg(most.alias("most")), steps, names, by, True)


def funnel_tolerant(df: DataFrame, steps: Sequence[Step], window_seconds: int = 7 * 86400, by: Sequence[str] = (), names: Sequence[str] | None = None, **columns: str) -> DataFrame:
    """strict = FALSE: a user counts at a step if the step occurs at all within the window of the user's first step-1 event."""
    c = _DEFAULTS | columns
    own = Window.partitionBy(*by, "__user")
    rows = _hits(df, steps, by, c).withColumn("t0", F.min(F.when(F.col("b").bitwiseAND(F.lit(1)) != 0, F.col("t"))).over(own))
    inside = (F.col("t") - F.col("t0")).between(0, window_seconds * 1_000_000)
    seen = [F.max(F.when(inside & (F.col("b").bitwiseAND(F.lit(1 << i)) != 0), 1).otherwise(0)).alias(f"s{i}") for i in range(len(steps))]
    labels = list(names or [s if isinstance(s, str) else f"step_{i + 1}" for i, s in enumerate(steps)])
    counts = rows.groupBy(*by, "__user").agg(*seen).groupBy(*by).agg(*[F.coalesce(F.sum(f"s{i}"), F.lit(0)).alias(f"n{i}") for i in range(len(steps))])
    out = F.array(*[F.struct(F.lit(i + 1).alias("step"), F.lit(labels[i]).alias("step_name"), F.col(f"n{i}").alias("users")) for i in range(len(steps))])
    return counts.select(*by, F.explode(out).alias("r")).select(*by, "r.*")
