"""Token ids in ORC files: run-length encoded integers, row indexes, Bloom filters on document ids."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, ship, whole_text

_FILE = "doc_id long, row long, n_tokens int, ids array<int>"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, file_bytes: int = 64 << 20, stripe_bytes: int = 64 << 20, index_rows: int = 1000, bloom_fpp: float = 0.01, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes every document's ids, end id included, to ORC files in ascending doc_id order (nulls first; rows of an id in a fixed order).

    The texts are range-partitioned by (id, hash of the text, row number) and sorted before they are encoded, so Spark's
    sampling of the ranges encodes nothing, and no file's rows have greater ids than the next file's. There is a range for every file_bytes
    of input, so ranges don't grow with the input; as the hash and the row number take part, rows of one id, also many equal ones or a mass
    without ids, are split like others. ORC stores ids, counts and row numbers run-length encoded; each stripe has a row index every
    index_rows rows and a Bloom filter on doc_id, so a reader prunes stripes by min/max or id, and stripes are read in parallel. Columns:
    doc_id, row (position in its file), n_tokens, ids. Null text counts as empty; other columns are not read.
    """

    def encode(batches):
        import numpy as np
        import pyarrow as pa

        from .tokens import encoder, slices

        enc, row = encoder(tokenizer, end_id), 0
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                ids, ends = enc.encode_batch(texts)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(np.arange(row, row + len(texts))), pa.array(np.diff(ends, prepend=0), pa.int32()), lists], names=["doc_id", "row", "n_tokens", "ids"])
                row += len(texts)

    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    key = ("doc_id", "h", "n")
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("n", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(ranges(docs, file_bytes), *key).sortWithinPartitions(*key).select("doc_id", "text").mapInArrow(encode, _FILE)
    options = {"compression": "zstd", "orc.stripe.size": stripe_bytes, "orc.row.index.stride": index_rows, "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": bloom_fpp}
    rows.write.options(**options).orc(path)


def ranges(docs: DataFrame, file_bytes: int) -> int:
    """One for every file_bytes of the optimizer's estimate, which is the files' size for a table; where it knows none, as many as docs has
    partitions. A shuffle's usual number at least."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size < 1 << 60
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // file_bytes) if known else docs.rdd.getNumPartitions())


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows, with the number of the file: doc_id, row, n_tokens, ids, part. Filters on doc_id prune stripes."""
    df = spark.read.schema(_FILE).option("pathGlobFilter", "*.orc").orc(path)
    return df.withColumn("part", F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long"))


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Running sums within each file, whose size the writer bounds, plus the totals of the files before it: a row per file is
    all that is summed in one place. Counts are of the ids read, not of the stored n_tokens."""

    def digest(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(2)
            offs, values = ids.offsets.to_numpy(), np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4"))
            view = memoryview(values).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(np.diff(offs).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "row", "part", "n_tokens", "ids_crc32"])

    ship(spark)
    rows = read_tokens(spark, path).select("doc_id", "row", "ids", "part").mapInArrow(digest, "doc_id long, row long, part long, n_tokens long, ids_crc32 long")
    totals = read_tokens(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    base = totals.select(F.col("part").alias("p"), (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("base"))
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    out = rows.withColumn("within", within).join(base, F.col("part") == F.col("p"))
    return out.select("doc_id", (F.col("within") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def encode_to_orc(docs: DataFrame, tokenizer: str, path: str | None = None, **options) -> DataFrame:
    """write_tokens to path (a scratch folder by default), then token_digest of the files. An empty table gives no rows."""
    spark = docs.sparkSession
    ship(spark)
    path = path or scratch(spark, "orc_tokens")
    write_tokens(docs, path, tokenizer, **options)
    return token_digest(spark, path)
