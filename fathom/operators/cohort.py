"""Cohort retention: one shuffle by user, then one by cohort. No array of a user's events is built."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_DAY = 86400 * 1_000_000
Event = str | Column  # a name, or a condition on the row


def _is(event: Event, column: str) -> Column:
    return F.coalesce(F.col(column) == event if isinstance(event, str) else event, F.lit(False))


def _micros(ts: str):
    return F.unix_micros(F.col(ts).cast("timestamp"))


def first_return(df: DataFrame, entry: Event, back: Event, user: str = "user_id", ts: str = "ts", event: str = "event_type", formatted: bool = False) -> DataFrame:
    """Weekly cohorts by the first entry event; a user is retained within 7, 14 or 30 days as the first return after it says.

    (cohort_week, cohort_size, day_7_retention, day_14_retention, day_30_retention); weeks count from the epoch. entry and back are event names or
    conditions. Ratios are numbers, or with formatted=True text such as '12.3%'. Null users are ignored."""
    rows = df.where(F.col(user).isNotNull()).select(F.col(user).alias("u"), _micros(ts).alias("t"), _is(entry, event).alias("a"), _is(back, event).alias("b")).where("a or b")
    rows = rows.withColumn("t0", F.min(F.when(F.col("a"), F.col("t"))).over(Window.partitionBy("u"))).where("t0 is not null")
    users = rows.groupBy("u").agg(F.first("t0").alias("t0"), F.min(F.when(F.col("b") & (F.col("t") > F.col("t0")), F.col("t"))).alias("nxt"))
    nxt = F.col("nxt")
    users = users.select(F.floor(F.col("t0") / (7 * _DAY)).alias("week"), F.floor((nxt - F.col("t0")) / _DAY).alias("days"))
    out = users.groupBy("week").agg(F.count("*").alias("cohort_size"), *[F.count_if(F.col("days") <= d).alias(f"n{d}") for d in (7, 14, 30)])
    share = lambda d: F.col(f"n{d}") / F.col("cohort_size")
    rate = lambda d: F.concat(F.format_string("%.1f", share(d) * 100), F.lit("%")) if formatted else F.round(share(d), 6)
    return out.select(F.concat(F.lit("Week "), F.col("week").cast("string")).alias("cohort_week"), "cohort_size", *[rate(d).alias(f"day_{d}_retention") for d in (7, 14, 30)])


def retention_matrix(df: DataFrame, entry: Event, back: Event, unit: str = "DAY", max_periods: int = 7, metric: str = "RETENTION_RATE", user: str = "user_id", ts: str = "ts", event: str = "event_type", event_id: str = "event_id") -> DataFrame:
    """(cohort, cohort_size, period, users, value): distinct users of a cohort that return in each later period, zero-filled.

    A cohort is the period (DAY, WEEK or MONTH of 30 days, from the epoch) of the first entry event; a return counts from then
    on, by (ts, event_id). value is the share of the cohort (RETENTION_RATE), the users (USER_COUNT), or the share of period 0 (CONVERSION_RATE)."""
    span = {"DAY": 1, "WEEK": 7, "MONTH": 30}[unit.upper()] * _DAY
    rows = df.where(F.col(user).isNotNull()).select(F.col(user).alias("u"), F.struct(_micros(ts).alias("t"), F.col(event_id).alias("i")).alias("at"), _is(entry, event).alias("a"), _is(back, event).alias("b")).where("a or b")
    # a user's distinct return periods are all that is kept of it
    starts = rows.where("a").groupBy("u").agg(F.min("at").alias("a0"))
    sizes = starts.groupBy(F.floor(F.col("a0.t") / span).alias("cohort")).agg(F.count("*").alias("cohort_size"))
    later = rows.where("b").join(starts, "u").where(F.col("at") >= F.col("a0"))
    hits = later.select("u", F.floor(F.col("a0.t") / span).alias("cohort"), (F.floor(F.col("at.t") / span) - F.floor(F.col("a0.t") / span)).alias("period")).where(F.col("period").between(0, max_periods))
    users = hits.distinct().groupBy("cohort", "period").agg(F.count("*").alias("users"))
    grid = sizes.withColumn("period", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max_periods).cast("long"))))
    out = grid.join(users, ["cohort", "period"], "left").withColumn("users", F.coalesce("users", F.lit(0)))
    if metric == "CONVERSION_RATE":
        zero = out.where("period = 0").select("cohort", F.col("users").alias("z"))
        out = out.join(zero, "cohort").withColumn("value", F.round(F.coalesce(F.try_divide(F.col("users"), F.col("z")), F.lit(0.0)), 6)).drop("z")
    elif metric == "USER_COUNT":
        out = out.withColumn("value", F.col("users").cast("double"))
    elif metric == "RETENTION_RATE":
        out = out.withColumn("value", F.round(F.col("users") / F.col("cohort_size"), 6))
    else:
        raise ValueError(f"unknown metric {metric!r}")
    return out.select("cohort", "cohort_size", "period", "users", "value")
