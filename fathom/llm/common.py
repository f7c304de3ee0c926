"""Helpers that the operators of this subpackage share: scratch tables, safe column picking, grouping of linked ids."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 4 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
FALLBACK_DIR = "file:///tmp/checkpoints"
_KEPT: list[dict] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir, which driver and executors share. Without that setting a local folder serves a local master, and a cluster is an error."""
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = FALLBACK_DIR
    path = f"{root.rstrip('/')}/fathom/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def materialize(df: DataFrame, name: str, **options) -> DataFrame:
    """Writes df to a scratch table and reads it again. It cuts lineage, and a lost executor costs only unfinished tasks."""
    ship(df.sparkSession)
    path = scratch(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def free(*tables: DataFrame) -> None:
    """Removes materialized tables that nothing reads any more: what was made from them is written already."""
    for df in tables:
        if path := getattr(df, "_scratch_path", None):
            jpath = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(jpath, True)


def give_back() -> None:
    """Returns memory that this process has freed to the system, where the C library can: the driver needs little of it again after a training, and a worker's counts for its executor while it is kept."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def kept() -> dict:
    """A table for what an operator's tasks keep in a Python worker for the next ones, until make_room()."""
    _KEPT.append({})
    return _KEPT[-1]


def make_room() -> None:
    """Drops what tasks of other operators have kept in this worker: workers outlive a query, and stay with what they keep while stages without Python run."""
    if any(_KEPT):
        for x in _KEPT:
            x.clear()
        gc.enable()
        gc.collect()
        give_back()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def _forest(batches):
    """Links (u, v) of one partition -> each node's link to the smallest node that it reaches within the partition."""
    import numpy as np
    import pyarrow as pa

    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not got:
        return
    u, v = (np.concatenate([x[i] for x in got]) for i in (0, 1))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    low = np.arange(len(nodes))
    while True:
        m = np.minimum(low[a], low[b])
        new = low.copy()
        for x in (a, b, low[a], low[b]):
            np.minimum.at(new, x, m)
        new = new[new]
        if (new == low).all():
            break
        low = new
    own = np.flatnonzero(low != np.arange(len(nodes)))
    for k in range(0, len(own), 100_000):
        part = own[k : k + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(nodes[part]), pa.array(nodes[low[part]])], names=["u", "v"])


def components(edges: DataFrame, max_rounds: int = 40, split_over: int = 1_000_000) -> DataFrame:
    """edges (a, b long) -> (node, root): root is the smallest id that node reaches. Ids without an edge have no row.

    Alternating large-star and small-star rounds: neighbourhoods shrink to stars around minima in O(log^2 n) rounds; after each, what a partition
    can join on its own is joined there, so chains mostly vanish in the first. Only minima are aggregated (with map-side combine) and
    joined back, so a hub's neighbours never meet in one group. From split_over links on the minima are written before they are joined: both
    sides of a join are then plain scans, of which AQE splits the partition of a hub. Nulls and self-links are ignored; repeated edges do no harm.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        return materialize(df, name) if now[0] > split_over else df

    def written(links: DataFrame) -> tuple[DataFrame, tuple]:
        """The links after _forest, as a table, with their number and sum, which the writing itself gives."""
        seen = Observation()
        links = links.distinct().mapInArrow(_forest, "u long, v long")
        links = materialize(links.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "edges")
        return links, (seen.get["n"], seen.get["h"])

    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e, now = written(e)
    for _ in range(max_rounds):
        if not now[0]:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = side(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "lowest")
        large = side(both.join(first, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        low = side(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        before, old = now, e
        e, now = written(small.where("u <> v"))
        free(old, first, low, large)
        if now == before:
            break
    else:
        raise RuntimeError(f"components: no fixed point after {max_rounds} rounds")
    return e.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node").union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package where neither PYTHONPATH nor the working folder has it, and bounds their Arrow batches.

    Spark bounds batches by rows alone unless told otherwise; texts can be long, so a bound in bytes is set where there is none."""
    now = spark.conf.get(_BATCH_KEY, str(2**31 - 1)).rstrip("bB")
    if now.isdigit() and int(now) > BATCH_BYTES:
        spark.conf.set(_BATCH_KEY, BATCH_BYTES)
    root = Path(__file__).resolve().parents[2]
    if Path.cwd() == root or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    sc = spark.sparkContext
    if getattr(sc, "_fathom_shipped", False):
        return
    archive = Path(tempfile.mkdtemp()) / "fathom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in (root / "fathom").rglob("*.py"):
            z.write(p, p.relative_to(root))
    sc.addPyFile(str(archive))
    sc._fathom_shipped = True
