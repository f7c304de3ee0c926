"""Mixing sources to target weights: capped water-filling, then whole repetitions and a seeded fraction. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WORD = r"[^\x20\x09-\x0D]+"
_BUCKET = 3  # hex digits of the hash: 4096 buckets a source


def n_words(column: str = "text") -> Column:
    """Number of runs of characters other than ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def _key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))


def _order(seed: int, doc: str, text: str) -> Column:
    """Rows of a source are taken in this order; the text takes part, as ids may be null or repeated."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text), F.lit("")))))


def _places(sizes: DataFrame) -> DataFrame:
    """sizes with the place (from 1) of each key in code point order, key '' last: keys are sorted in ranges, and a range adds the numbers of those before it."""
    last = (F.col("key") == "").alias("last")
    n = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sizes.select("*", last).repartitionByRange(n, "last", "key").withColumn("part", F.spark_partition_id())
    dealt = materialize(dealt, "mix_sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("part").agg(F.count("*").alias("n")).select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("part").orderBy("last", "key"))
    return dealt.withColumn("own", own).join(F.broadcast(base), F.col("part") == F.col("p")).select("key", "size", (F.col("base") + F.col("own")).alias("place"))


def targets(sizes: DataFrame, max_epochs: float = 3, weights: Sequence[float] = (1, 2, 3)) -> DataFrame:
    """sizes (key, size long, one row per source) -> (key, source_size, target double).

    Sources by key, code point order, the null source (key '') last, take the weights in turn; they share the sum of all sizes.
    Capped water-filling: sources that the present level, times their weight, puts above max_epochs * size are clamped there, and what they
    leave is shared anew by weight, until none is above. The clamped ones stay clamped (the level only rises), so a round is one sum over the
    sources, wherever they lie, and a level is all that the driver holds."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    s = materialize(_places(sizes).withColumn("w", w).withColumn("cap", F.col("size") * F.lit(float(max_epochs))), "mix_weights")
    total = s.agg(F.sum("size")).first()[0]
    left, rest, n = float(total or 0), None, -1
    over = F.lit(False)
    while True:
        clamped, fixed, free = s.agg(F.count_if(over), F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("w")))).first()
        left, rest = float(total or 0) - (fixed or 0.0), free
        if clamped == n or not rest:
            break
        n = clamped
        over = F.col("cap") <= F.lit(left) * F.col("w") / F.lit(rest)
    return s.select("key", F.col("size").alias("source_size"), F.when(over, F.col("cap")).otherwise(F.lit(left) * F.col("w") / F.lit(rest or 1.0)).alias("target"))


def plan(sized: DataFrame, seed: int = 13, max_epochs: float = 3, weights: Sequence[float] = (1, 2, 3)) -> DataFrame:
    """sized (key, size, h) -> (key, source_size, target, whole, upto, at_size, some): what each source takes.

    Every document of a source is repeated `whole` times, and once more those before (upto, at_size) in the order of (h, size), and
    `some` of the rows there: documents are added as long as that brings the source nearer to its target, so it is off by at most half a
    document. Sums per source and hash bucket find the bucket where the target falls; only that bucket's rows (1 of 4096) are put in
    order, and rows of equal h and size as one. A source's sums are at most 4096 rows, so a source with most of the rows costs no more than others.
    """
    buckets = materialize(sized.groupBy("key", F.substring("h", 1, _BUCKET).alias("bucket")).agg(F.sum("size").alias("size")), "mix_buckets")
    goal = targets(buckets.groupBy("key").agg(F.sum("size").alias("size")), max_epochs, weights)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = goal.withColumn("whole", F.floor(rate)).withColumn("part", F.col("target") - F.col("whole") * F.col("source_size"))
    goal = materialize(goal, "mix_targets")
    by = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    run = buckets.withColumn("end", F.sum("size").over(by)).join(goal.select("key", "part"), "key")
    edge = materialize(run.where("end > part").groupBy("key").agg(F.min(F.struct("bucket", (F.col("end") - F.col("size")).alias("base"), "part")).alias("e")).select("key", "e.*"), "mix_edges")
    inside = sized.where("size > 0").withColumn("bucket", F.substring("h", 1, _BUCKET)).join(edge, ["key", "bucket"])
    inside = inside.groupBy("key", "h", "size").agg(F.count("*").alias("n"), F.first("base").alias("base"), F.first("part").alias("part"))
    before = F.sum(F.col("n") * F.col("size")).over(Window.partitionBy("key").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n") * F.col("size")
    # the i-th of equal rows is taken if what comes before it and half of it are within the target
    fit = F.greatest(F.lit(0), F.floor((F.col("part") - F.col("base") - before) / F.col("size") + 0.5))
    last = inside.withColumn("some", fit).where("some < n").groupBy("key").agg(F.min(F.struct("h", "size", "some")).alias("x"))
    out = goal.join(edge.select("key", "bucket"), "key", "left").join(last, "key", "left")
    # without a bucket beyond the target, or a row in it that is left out, everything is taken: 'g' is after all hashes
    upto = F.coalesce(F.col("x.h"), F.when(F.col("bucket").isNotNull(), F.concat("bucket", F.lit("g"))), F.lit("g"))
    return materialize(out.select("key", "source_size", "target", "whole", upto.alias("upto"), F.coalesce("x.size", F.lit(0)).alias("at_size"), F.coalesce("x.some", F.lit(0)).alias("some")), "mix_plan")


def _with_times(rows: DataFrame, p: DataFrame, key: Column, size: Column, h: Column) -> DataFrame:
    """rows with __mix, their source's plan, and __times, how often each is taken.

    Only where equal rows share the last place is it counted which of them go in: they are numbered within their partition, and a partition
    adds the numbers of those before it, so they never meet in one task."""
    rows = rows.join(p.select(F.struct(*p.columns).alias("__mix")), key == F.col("__mix.key"))
    m = lambda c: F.col(f"__mix.{c}")
    there = (h == m("upto")) & (size == m("at_size")) & (m("some") > 0)
    before = (h < m("upto")) | ((h == m("upto")) & (size < m("at_size")))
    plain = rows.where(~there).withColumn("__times", m("whole") + F.when(before, 1).otherwise(0))
    ties = materialize(rows.where(there).withColumn("__part", F.spark_partition_id()), "mix_ties")
    counts = ties.groupBy(m("key").alias("k"), F.col("__part").alias("p")).agg(F.count("*").alias("n"))
    counts = counts.withColumn("base", F.sum("n").over(Window.partitionBy("k").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).drop("n")
    own = F.row_number().over(Window.partitionBy("__mix.key", "__part").orderBy("__part"))
    ties = ties.withColumn("__own", own).join(counts.select(F.struct("*").alias("__c")), (m("key") == F.col("__c.k")) & (F.col("__part") == F.col("__c.p")))
    ties = ties.withColumn("__times", m("whole") + F.when(F.col("__c.base") + F.col("__own") <= m("some"), 1).otherwise(0))
    return plain.union(ties.select(*plain.columns))


def _sized(docs: DataFrame, seed: int, id_col: str, source_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), _key(source_col).alias("key"), n_words(text_col).alias("size"), _order(seed, id_col, text_col).alias("h"))


def mixture(docs: DataFrame, seed: int = 13, max_epochs: float = 3, weights: Sequence[float] = (1, 2, 3), id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """doc_id, size, source_size, target, taken (words taken, repetitions counted) of every document.

    Null text has size 0, a null source is a source of its own. Rows of null or repeated ids are told apart by their texts; of rows that are
    equal in id, source and text as many go in as the target asks for, whichever. Sources without words have target 0. An empty table gives
    no rows. Other columns are not read."""
    sized = materialize(_sized(docs, seed, id_col, source_col, text_col), "mix_sizes")
    got = _with_times(sized, plan(sized, seed, max_epochs, weights), F.col("key"), F.col("size"), F.col("h"))
    return got.select("doc_id", "size", "__mix.source_size", "__mix.target", (F.col("size") * F.col("__times")).cast("long").alias("taken"))


def mix(docs: DataFrame, seed: int = 13, max_epochs: float = 3, weights: Sequence[float] = (1, 2, 3), id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mixture itself: each row of docs as often as mixture() takes it, all columns as they are."""
    sized = materialize(_sized(docs, seed, id_col, source_col, text_col), "mix_sizes")
    own = docs.columns
    rows = _with_times(docs, plan(sized, seed, max_epochs, weights), _key(source_col), n_words(text_col), _order(seed, id_col, text_col))
    return rows.withColumn("__copy", F.explode(F.array_repeat(F.lit(True), F.col("__times").cast("int")))).select(*[F.col(f"`{c}`") for c in own])


def oracle(documents: str = "documents", seed: int = 13) -> str:
    """DuckDB SQL for mixture() with its default parameters."""
    return f"""
WITH sized AS (
  SELECT doc_id, source, COALESCE('=' || source, '') AS key, COALESCE(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5('{seed}:' || COALESCE(doc_id::VARCHAR, '') || ':' || md5(COALESCE(text, ''))) AS h FROM {documents}),
sources AS (SELECT key, SUM(size)::BIGINT AS size FROM sized GROUP BY key),
placed AS (SELECT *, row_number() OVER (ORDER BY key = '', key) AS place FROM sources),
weighed AS (SELECT *, (place - 1) % 3 + 1.0::DOUBLE AS w, size * 3.0::DOUBLE AS cap, (SUM(size) OVER ())::DOUBLE AS total FROM placed),
run AS (SELECT *, total - COALESCE(SUM(cap) OVER (ORDER BY cap / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS l,
         SUM(w) OVER (ORDER BY cap / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r FROM weighed),
level AS (SELECT arg_min(l, cap / w) AS l, arg_min(r, cap / w) AS r FROM run WHERE NOT cap <= l * w / r AND place = (SELECT arg_min(place, (cap / w, place)) FROM run WHERE NOT cap <= l * w / r)),
goal AS (SELECT key, size AS source_size, CASE WHEN cap <= run.l * w / run.r THEN cap ELSE level.l * w / level.r END AS target FROM run LEFT JOIN level ON TRUE),
whole AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM goal),
ordered AS (SELECT s.*, source_size, target, whole,
         SUM(s.size) OVER (PARTITION BY key ORDER BY h, s.size ROWS UNBOUNDED PRECEDING) - s.size / 2.0::DOUBLE AS mid FROM sized s JOIN whole USING (key))
SELECT doc_id, size, source_size::BIGINT AS source_size, target, (size * (whole + CASE WHEN mid <= target - whole * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM ordered"""
