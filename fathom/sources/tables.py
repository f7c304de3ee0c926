"""Table readers and writers. Column pruning and filters reach the files, as every reader returns a plain scan."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
FORMATS = ("parquet", "orc", "json", "csv", "avro")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream with ts as an instant (UTC); files hold timestamps without a zone."""
    return read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir, which driver and executors share. Without that setting a local folder serves a local master, and a cluster is an error."""
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file:///tmp/checkpoints"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def as_of(left: DataFrame, right: DataFrame, on: str, ts: str, columns: list[str]) -> DataFrame:
    """left with the columns of the latest row of right of the same key at or before its time (null without one).

    One union, one shuffle by key and one sort: a window carries the last row of right on. Of right rows of equal time the one with the largest columns wins; null keys
    match nothing."""
    key = F.col(on).alias("__k")
    a = left.select(key, F.col(ts).alias("__t"), F.lit(1).alias("__side"), F.struct("*").alias("__l"), F.lit(None).cast(right.select(F.struct(*columns)).schema[0].dataType).alias("__r"))
    b = right.where(F.col(on).isNotNull()).select(key, F.col(ts).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("__l"), F.struct(*columns).alias("__r"))
    past = Window.partitionBy("__k").orderBy("__t", "__side", "__r").rowsBetween(Window.unboundedPreceding, 0)
    rows = a.unionByName(b).withColumn("__r", F.last("__r", True).over(past)).where("__side = 1")
    return rows.select("__l.*", *[F.when(F.col("__k").isNotNull(), F.col(f"__r.{c}")).alias(c) for c in columns])


def register(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> None:
    """Temporary views for SQL, one per table."""
    for name in names:
        read(spark, sf_dir, name).createOrReplaceTempView(name)


def external(spark: SparkSession, fmt: str, path: str, schema: T.StructType | str | None = None, **options) -> DataFrame:
    """An external table: Parquet, ORC, JSON, CSV (delimiter, header) or Avro; the schema is given, never inferred, for text formats."""
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format {fmt!r}; one of {FORMATS}")
    if fmt in ("json", "csv") and schema is None:
        raise ValueError(f"{fmt} needs a schema")
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def json_lines(lines: DataFrame, schema: T.StructType, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Typed rows and dead letters of JSON lines: what doesn't parse, or lacks a field that must not be null, goes to the second."""
    corrupt = "_corrupt"
    wide = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields] + [T.StructField(corrupt, T.StringType(), True)])
    rows = lines.withColumn("r", F.from_json(column, wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}))
    must = [F.col(f"r.{f.name}").isNull() for f in schema.fields if not f.nullable]
    bad = F.col("r").isNull() | F.col(f"r.{corrupt}").isNotNull()
    for m in must:
        bad = bad | m
    good = rows.where(~bad).select(*[F.col(f"r.{f.name}").alias(f.name) for f in schema.fields])
    return good, rows.where(bad).select(F.col(column).alias("record"))


def write_partitioned(df: DataFrame, path: str, time_col: str, unit: str = "DAY", fmt: str = "parquet", bloom_on: str | None = None) -> None:
    """Appends df in automatic range partitions named p_YYYY[_MM[_DD]] (UTC); optional Bloom filter on a lookup column."""
    w = df.withColumn("p", partition_name(time_col, unit)).write.mode("append").partitionBy("p").format(fmt)
    if bloom_on:
        w = w.option(f"parquet.bloom.filter.enabled#{bloom_on}", "true")
    w.save(path)


def partition_name(time_col: str, unit: str = "DAY"):
    """p_2024_01_31, p_2024_01 or p_2024: lower bound inclusive, upper bound exclusive."""
    pattern = {"DAY": "yyyy_MM_dd", "MONTH": "yyyy_MM", "YEAR": "yyyy"}[unit.upper()]
    return F.concat(F.lit("p_"), F.date_format(time_col, pattern))


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int = 64, sort: tuple[str, ...] = ()) -> None:
    """Hash-distributed, optionally sorted, managed table: two such tables with equal buckets join on their key without a shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(*(sort or (key,))).saveAsTable(table)


def live(df: DataFrame, time_col: str, retain: str, now: str) -> DataFrame:
    """Rows that a time-to-live keeps: ts >= now - retain. A row exactly at the limit stays; a null time stays."""
    limit = F.expr(f"timestamp '{now}' - interval {retain}")
    return df.where((F.col(time_col) >= limit) | F.col(time_col).isNull())
