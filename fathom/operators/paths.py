"""Paths: n-grams over whole timelines, and paths within sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ngrams(df: DataFrame, length: int = 3, top: int | None = 20, user: str = "user_id", ts: str = "ts", event: str = "event_type", event_id: str = "event_id", min_support: int = 1, session: str | None = None, where: Column | None = None, formatted: bool = False, entry: str | None = None, exit: str | None = None, as_array: bool = False) -> DataFrame:
    """(path, count, user_count, percentage) of all contiguous n-grams, most frequent first, ties by path.

    Timelines are windows by user (and session, if given), in the order (ts, event_id); percentage is of all n-grams. Rows without user or
    event name are no steps. entry and exit keep the n-grams that begin or end there; path is text, or an array with as_array."""
    rows = df.where(F.col(user).isNotNull() & F.col(event).isNotNull())
    rows = rows if where is None else rows.where(where)
    w = Window.partitionBy(user, *([session] if session else [])).orderBy(ts, event_id)
    steps = [F.col(event).cast("string")] + [F.lead(F.col(event).cast("string"), k).over(w) for k in range(1, length)]
    grams = rows.select(F.col(user).alias("u"), *[s.alias(f"s{k}") for k, s in enumerate(steps)])
    if length > 1:
        grams = grams.where(F.col(f"s{length - 1}").isNotNull())
    for k, name in ((0, entry), (length - 1, exit)):
        if name is not None:
            grams = grams.where(F.col(f"s{k}") == name)
    names = [f"s{k}" for k in range(length)]
    per_user = grams.groupBy((F.array(*names) if as_array else F.concat_ws(" => ", *names)).alias("path"), "u").agg(F.count("*").alias("n"))
    out = per_user.groupBy("path").agg(F.sum("n").alias("count"), F.count("*").alias("user_count"))
    total = out.agg(F.sum("count").alias("total"))
    share = F.col("count") / F.col("total")
    out = out.crossJoin(total).where(F.col("count") >= min_support)
    out = out.select("path", "count", "user_count", (F.concat(F.format_string("%.1f", share * 100), F.lit("%")) if formatted else F.round(share * 100, 6)).alias("percentage"))
    return out.orderBy(F.desc("count"), "path").limit(top) if top else out


def session_paths(df: DataFrame, start: str | None = None, end: str | None = None, max_depth: int = 5, gap_seconds: int = 1800, top: int = 20, user: str = "user_id", ts: str = "ts", event: str = "event_type", event_id: str = "event_id") -> DataFrame:
    """(rank, path, count): paths of at least two events within sessions.

    A path breaks where the gap since its last event exceeds gap_seconds; it begins at `start` (or any event), ends at `end` or at
    max_depth, and what is left at a break or at the end counts too. One fold per user; ties rank by path."""
    gap = gap_seconds * 1_000_000
    rows = df.where(F.col(user).isNotNull() & F.col(event).isNotNull()).select(F.col(user).alias("u"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(event_id).alias("i"), F.col(event).alias("e"))
    lines = rows.groupBy("u").agg(F.array_sort(F.collect_list(F.struct("t", "i", "e"))).alias("line"))
    # breaks after the last appended event need the fold only where events are skipped; marks: 0 skip, 1 begin, 2 append
    zero = F.struct(F.lit(0).alias("n"), F.lit(None).cast("long").alias("last"), F.array().cast("array<struct<p:int,e:string>>").alias("out"), F.lit(0).alias("p"))

    def step(s: Column, x: Column) -> Column:
        broken = (s["n"] > 0) & (x["t"] - s["last"] > gap)
        n = F.when(broken, 0).otherwise(s["n"])
        take = (n > 0) | (F.lit(True) if start is None else x["e"] == start)
        begins = take & (n == 0)
        p = F.when(begins, s["p"] + 1).otherwise(s["p"])
        done = take & ((n + 1 >= max_depth) | (F.lit(False) if end is None else x["e"] == end))
        out = F.when(take, F.array_append(s["out"], F.struct(p.cast("int").alias("p"), x["e"].alias("e")))).otherwise(s["out"])
        return F.struct(F.when(done, 0).when(take, n + 1).otherwise(n).alias("n"), F.when(take, x["t"]).otherwise(s["last"]).alias("last"), out.alias("out"), p.alias("p"))

    if start is None and end is None:
        # without skipping, a path is a run of at most max_depth events of a session: a window expresses it
        w = Window.partitionBy("u").orderBy("t", "i")
        r = rows.withColumn("s", F.sum(F.when(F.col("t") - F.lag("t").over(w) > gap, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        r = r.withColumn("k", F.floor((F.row_number().over(Window.partitionBy("u", "s").orderBy("t", "i")) - 1) / max_depth))
        paths = r.groupBy("u", "s", "k").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "i", "e"))), lambda x: x["e"]).alias("path"))
    else:
        marked = lines.select("u", F.posexplode(F.aggregate("line", zero, step)["out"]).alias("pos", "x"))
        paths = marked.groupBy("u", F.col("x.p").alias("p")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda y: y["x"]["e"]).alias("path"))
    out = paths.where(F.size("path") >= 2).groupBy(F.concat_ws(" => ", "path").alias("path")).agg(F.count("*").alias("count"))
    out = out.orderBy(F.desc("count"), "path").limit(top)
    return out.select(F.row_number().over(Window.orderBy(F.desc("count"), "path")).alias("rank"), "path", "count")
