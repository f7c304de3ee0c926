"""A training corpus from raw documents: toxic texts go, one of each near-duplicate group stays, personal data is masked, sources are mixed, and the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import mixing, packing, pii, shingles, toxicity
from fathom.llm.common import materialize, table
from fathom.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trains on this stage's input and its labels, and keeps what the model does not reject."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs.select(*COLUMNS), model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """By SimHash over five-word shingles, with an exact check: of each component of texts with a similarity of 0.8 or more in them one row stays: that of the smallest id, then of the smallest row number. A row without an id stays only where no row of its component has one."""
    rows = materialize(docs.select(*COLUMNS).withColumn("__row", F.monotonically_increasing_id()), "numbered")
    of = shingles.similar_groups(rows, row_col="__row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("first")
    keep = materialize(of.groupBy("root").agg(first).select(F.col("first.row").alias("kept")), "kept")
    return rows.join(keep.hint("merge"), F.col("__row") == F.col("kept"), "left_semi").select(*COLUMNS)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every base or discovered span gives way to its kind; n_chars follows the new text."""
    clean = pii.redact(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mixing.mix(docs.select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece with its place in a sequence; each copy of a repeated document has its own pieces."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Trained models, fingerprints and byte-pair encoding are beyond SQL; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each stage's result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
