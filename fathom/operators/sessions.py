"""Sessionization: by window functions, one shuffle by user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_sessions(df: DataFrame, timeout_seconds: int = 1800, user: str | Column = "user_id", ts: str = "ts", event_id: str = "event_id") -> DataFrame:
    """df with user_key, session_id, session_seq (from 1), session_start, session_end, session_duration_secs and is_new_user per event.

    A gap of more than the timeout begins a session; an equal gap doesn't. Ids are hashes of user and start, so reruns agree. Rows
    with a null user key are dropped. The user key may be any expression, such as coalesce(user_id, device_id)."""
    key = F.col(user) if isinstance(user, str) else user
    rows = df.withColumn("user_key", key).where("user_key is not null").withColumn("__t", F.unix_micros(F.col(ts).cast("timestamp")))
    w = Window.partitionBy("user_key").orderBy("__t", event_id)
    fresh = F.when(F.lag("__t").over(w).isNull() | (F.col("__t") - F.lag("__t").over(w) > timeout_seconds * 1_000_000), 1).otherwise(0)
    rows = rows.withColumn("__new", fresh).withColumn("session_seq", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = Window.partitionBy("user_key", "session_seq")
    rows = rows.withColumn("__a", F.min("__t").over(s)).withColumn("__b", F.max("__t").over(s))
    rows = rows.withColumn("session_id", F.sha2(F.concat_ws(":", F.col("user_key").cast("string"), F.col("__a").cast("string")), 256))
    rows = rows.withColumn("session_start", F.timestamp_micros("__a")).withColumn("session_end", F.timestamp_micros("__b"))
    rows = rows.withColumn("session_duration_secs", F.floor((F.col("__b") - F.col("__a")) / 1_000_000)).withColumn("is_new_user", F.col("session_seq") == 1)
    return rows.drop("__t", "__new", "__a", "__b")


def sessionize(df: DataFrame, timeout_seconds: int = 1800, user: str | Column = "user_id", ts: str = "ts", event: str = "event_type", event_id: str = "event_id") -> DataFrame:
    """One row per session: session_id, user_key, session_start, session_end, session_event_count, duration_secs, event_sequence, time_sequence, id_sequence."""
    rows = with_sessions(df, timeout_seconds, user, ts, event_id)
    line = F.array_sort(F.collect_list(F.struct(F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(event_id).alias("i"), F.col(event).alias("e"))))
    out = rows.groupBy("user_key", "session_seq").agg(F.first("session_id").alias("session_id"), F.min("session_start").alias("session_start"), F.max("session_end").alias("session_end"), F.count("*").alias("session_event_count"), F.first("session_duration_secs").alias("duration_secs"), line.alias("line"))
    return out.select("session_id", "user_key", "session_seq", "session_start", "session_end", "session_event_count", "duration_secs", F.transform("line", lambda x: x["e"]).alias("event_sequence"), F.transform("line", lambda x: x["t"]).alias("time_sequence"), F.transform("line", lambda x: x["i"]).alias("id_sequence"))


def session_stats(sessions: DataFrame) -> DataFrame:
    """Input events, sessions, users, and events per session."""
    return sessions.agg(F.sum("session_event_count").cast("long").alias("events"), F.count("*").alias("sessions"), F.count_distinct("user_key").alias("users"), F.round(F.avg("session_event_count"), 6).alias("avg_events"))


def events_of(sessions: DataFrame, user: str = "user_id", ts: str = "ts", event: str = "event_type", event_id: str = "event_id") -> DataFrame:
    """The events behind a session table, so that behavioural operators answer from it exactly, across session ends too."""
    z = F.explode(F.arrays_zip("event_sequence", "time_sequence", "id_sequence"))
    return sessions.select("user_key", z.alias("z")).select(F.col("user_key").alias(user), F.timestamp_micros("z.time_sequence").alias(ts), F.col("z.event_sequence").alias(event), F.col("z.id_sequence").alias(event_id))


def refresh(sessions: DataFrame, events: DataFrame, batch: DataFrame, timeout_seconds: int, **columns) -> DataFrame:
    """The session table after a batch of new events: sessions of users in the batch are built anew from all their events, others stay."""
    user = columns.get("user", "user_id")
    touched = batch.select(F.col(user).alias("__u")).where("__u is not null").distinct()
    again = events.unionByName(batch).join(touched, F.col(user) == F.col("__u"), "left_semi")
    kept = sessions.join(touched, F.col("user_key") == F.col("__u"), "left_anti")
    return kept.unionByName(sessionize(again, timeout_seconds, **columns))
