"""Flat-JSON promotion: which top-level keys occur often enough, of which type, and as columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RANK = {"null": 0, "bool": 1, "int64": 2, "float64": 3, "string": 4}
_SPARK = {"null": "string", "bool": "boolean", "int64": "bigint", "float64": "double", "string": "string"}


def key_stats(df: DataFrame, column: str) -> DataFrame:
    """(key, occurrences, occurrence_rate, type): one pass. Rows that don't parse count in the denominator. Types widen
    null < int64 < float64 < string, booleans only with booleans; nested values are strings."""
    n = df.select(F.count("*").alias("rows"))
    v = df.select(F.explode(F.from_json(column, "map<string,string>")).alias("key", "v"))  # each document is parsed once
    kind = F.when(F.col("v").isNull(), "null").when(F.col("v").isin("true", "false"), "bool").when(F.col("v").rlike(r"^-?\d{1,18}$"), "int64").when(F.col("v").rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), "float64").otherwise("string")
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in _RANK.items() for x in kv]), kind)
    per = v.groupBy("key").agg(F.count("*").alias("occurrences"), F.max(rank).alias("hi"), F.max(F.when(kind == "bool", 1).otherwise(0)).alias("some_bool"), F.max(F.when(kind.isin("int64", "float64", "string"), 1).otherwise(0)).alias("some_other"))
    kind = F.when((F.col("some_bool") == 1) & (F.col("some_other") == 1), "string").when(F.col("hi") == 0, "null").when(F.col("hi") == 1, "bool").when(F.col("hi") == 2, "int64").when(F.col("hi") == 3, "float64").otherwise("string")
    return per.crossJoin(n).select("key", "occurrences", F.round(F.col("occurrences") / F.col("rows"), 6).alias("occurrence_rate"), kind.alias("type"))


def promote(df: DataFrame, column: str, threshold: float = 0.5, prefix: str = "") -> DataFrame:
    """df with a typed column for each key whose occurrence is at least the threshold; at most as many as the JSON has frequent keys.

    A key whose name is taken (in any case) gets underscores behind it. Each document is parsed once, whatever the keys' names hold."""
    frequent = key_stats(df, column).where(F.col("occurrence_rate") >= threshold).orderBy("key").collect()
    taken, parsed, out = {c.lower() for c in df.columns}, F.from_json(column, "map<string,string>"), []
    for r in frequent:
        name = prefix + r.key
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(F.col("__json")[r.key].try_cast(_SPARK[r.type]).alias(name))
    return df.withColumn("__json", parsed).select(*[F.col(f"`{c}`") for c in df.columns], *out)
