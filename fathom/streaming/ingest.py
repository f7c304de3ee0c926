"""Streams from files or Kafka into tables, pre-aggregates and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import json_lines

EVENTS = T.StructType([T.StructField("event_id", T.LongType(), False), T.StructField("ts", T.TimestampType(), False), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def files(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Lines of files that arrive in a folder."""
    return spark.readStream.format("text").option("maxFilesPerTrigger", max_files).load(path)


def kafka(spark: SparkSession, servers: str, topic: str, **options) -> DataFrame:
    """Message values of a topic, as a routine load reads them; offsets live in the query's checkpoint."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).options(**options).load()
    return raw.select(F.col("value").cast("string").alias("value"))


def routine_load(lines: DataFrame, table_path: str, dead_path: str, checkpoint: str, schema: T.StructType = EVENTS, key: str = "event_id", time_col: str = "ts", delay: str = "1 hour"):
    """Good records to a Parquet table, once each within the delay, and bad ones to a dead-letter folder; each batch is written whole or not at all."""
    good, bad = json_lines(lines, schema)
    good = good.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([key])
    a = good.writeStream.format("parquet").option("path", table_path).option("checkpointLocation", f"{checkpoint}/good").trigger(availableNow=True).start()
    b = bad.writeStream.format("text").option("path", dead_path).option("checkpointLocation", f"{checkpoint}/bad").trigger(availableNow=True).start()
    return a, b


def _versions(spark: SparkSession, path: str) -> tuple[list[int], list[int]]:
    """(batches, merged): the numbers of the batches' own states at path/<n>, and of states merged up to batch n at path/whole-<n>."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(jpath)] if fs.exists(jpath) else []
    done = [n for n in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return sorted(int(n) for n in done if n.isdigit()), sorted(int(n[6:]) for n in done if n.startswith("whole-"))


def view_state(spark: SparkSession, view, path: str, before: int | None = None) -> DataFrame | None:
    """The mergeable state that incremental_view keeps at path, of all batches (or those before one); None if there is none."""
    batches, merged = _versions(spark, path)
    merged = [n for n in merged if before is None or n < before]
    last = merged[-1] if merged else -1
    parts = [f"{path}/whole-{last}"] * bool(merged) + [f"{path}/{n}" for n in batches if n > last and (before is None or n < before)]
    return view.rollup(spark.read.parquet(*parts), view.spec.group_by) if parts else None


def incremental_view(stream: DataFrame, view, path: str, checkpoint: str, every: int = 16):
    """Keeps a pre-aggregate's mergeable state: each batch is aggregated alone and written to path/<batch>, and every so many batches what is there is merged.

    A batch that runs again overwrites its own state, so the result is exactly-once; what a merged state holds is removed once a later batch
    comes, which shows that the merge was committed. view_state() reads the whole."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fs_path = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        batches, merged = _versions(spark, path)
        sure = [n for n in merged if n < number]
        if sure:
            old = [str(n) for n in batches if n <= sure[-1]] + [f"whole-{n}" for n in sure[:-1]]
            for name in old:
                fs_path(name).getFileSystem(spark._jsc.hadoopConfiguration()).delete(fs_path(name), True)
        view.state(batch).write.mode("overwrite").parquet(f"{path}/{number}")
        if number % every == every - 1:
            view_state(spark, view, path, number + 1).write.mode("overwrite").parquet(f"{path}/whole-{number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_sessions(events: DataFrame, timeout: str = "30 minutes", delay: str = "1 hour", user: str = "user_id", ts: str = "ts") -> DataFrame:
    """Closed sessions of a stream (append mode): (user_key, session_start, session_end, session_event_count). Events later than the delay are dropped."""
    e = events.withWatermark(ts, delay)
    g = e.groupBy(F.col(user).alias("user_key"), F.session_window(ts, timeout).alias("w")).agg(F.count("*").alias("session_event_count"), F.max(ts).alias("session_end"))
    return g.select("user_key", F.col("w.start").alias("session_start"), "session_end", "session_event_count")


def windowed_counts(events: DataFrame, window: str = "1 hour", slide: str | None = None, delay: str = "1 hour", by: str = "event_type", ts: str = "ts") -> DataFrame:
    """Tumbling or sliding event-time counts."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    return events.withWatermark(ts, delay).groupBy(w.alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), by, "n")
