"""SimHash near-duplicates: fingerprints, their links by a segment-popcount embedding, and components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, ship, whole_text

_ODD = 0x55555555


def shingle_hashes(text: str | None, words: int, at_once: int = 65536) -> Iterator:
    """The XXH64 (seed 42) of a text's shingles, repeats included, as unsigned arrays; a text of fewer words is one shingle, without words there is none."""
    from itertools import islice

    import numpy as np
    from xxhash import xxh64_intdigest

    w = (text or "").encode().lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not w:
        return
    grams = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else iter([b" ".join(w)])
    while got := [xxh64_intdigest(g, 42) for g in islice(grams, at_once)]:
        yield np.array(got, dtype="<u8")


def majority(hashes: Iterable) -> int:
    """The bits that are set in over half of all hashes of the arrays, as a signed long."""
    import numpy as np

    counts, n = np.zeros(64, dtype=np.int64), 0
    for h in hashes:
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the 64-bit SimHash of each whole text, as a signed long.

    Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; shingles of consecutive words, repeats included, joined by a
    blank (a text of fewer words is one shingle; without words, or null: 0). A bit is set if it is set in over half of the
    shingles' XXH64 (seed 42)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([majority(shingle_hashes(x.as_py(), shingle)) for x in batch.column(1)], pa.int64())], names=["doc_id", "fp"])

    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def cells(fps: DataFrame) -> DataFrame:
    """fps (fp long) -> (cell, fp, own): the grid cells of the popcount embedding that each fingerprint takes part in.

    Embedding: 32 segments of two bits, each mapped to its count of ones (0 to 2); the Manhattan distance of two embedded
    fingerprints is at most their Hamming distance. Of three differing units, one half of the segments holds at most one. So
    two fingerprints within Hamming distance 3 have, in some half, count vectors that are equal or differ by one in one
    segment. A cell is a half's count vector. A fingerprint owns its cell in either half and also visits the cells one below it
    in one segment: with that, every such pair meets in the cell of the lower one. At most 34 rows per fingerprint.
    """
    halves = F.array(F.struct(F.lit(0).alias("h"), F.col("fp").bitwiseAND(0xFFFFFFFF).alias("x")), F.struct(F.lit(1).alias("h"), F.shiftrightunsigned("fp", 32).alias("x")))
    x = fps.select("fp", F.explode(halves).alias("x")).select("fp", "x.h", F.expr(f"(x.x & {_ODD}L) + (shiftright(x.x, 1) & {_ODD}L)").alias("v"))  # two bits a segment, in place
    visits = F.array(F.lit(None).cast("int"), *[F.when(F.expr(f"shiftright(v, {2 * s}) & 3") > 0, F.lit(s)).otherwise(F.lit(-1)) for s in range(16)])
    x = x.select("fp", "h", "v", F.explode(visits).alias("s")).where("s is null or s >= 0")
    cell = F.expr("shiftleft(cast(h as bigint), 32) | (v - if(s is null, 0L, shiftleft(1L, 2 * s)))")
    return x.select(cell.alias("cell"), "fp", F.col("s").isNull().alias("own"))


def _block_links(distance: int, small: int):
    """Rows (cell, fp, own), sorted by cell and fp -> links (a, b) within the distance that span each cell's links."""

    def spanning(fps, np):
        """Breadth first over the links of one large cell: each fingerprint found is compared with those not found yet."""
        out_a, out_b = [], []
        left = fps
        while len(left):
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                u = queue.pop()
                near = np.bitwise_count(left ^ u) <= distance
                if near.any():
                    found = left[near]
                    left = left[~near]
                    out_a.append(np.full(len(found), u))
                    out_b.append(found)
                    queue.extend(found)
        return out_a, out_b

    def links(cell, fp, own, np):
        """All whole cells of a piece of the sorted rows."""
        start = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        size = np.diff(np.append(start, len(cell)))
        owned = np.add.reduceat(own.astype(np.int64), start) > 0
        out_a, out_b = [], []
        for k in np.flatnonzero(owned & (size > small)):
            a, b = spanning(np.unique(fp[start[k] : start[k] + size[k]]), np)
            out_a += a
            out_b += b
        rows = np.repeat(owned & (size <= small) & (size > 1), size)
        c, f, o = cell[rows], fp[rows], own[rows]
        for shift in range(1, small):  # each row with the shift-th after it; pairs without an owner meet elsewhere
            if len(c) <= shift:
                break
            same = c[shift:] == c[:-shift]
            if not same.any():
                break
            hit = same & (o[shift:] | o[:-shift]) & (np.bitwise_count(f[shift:] ^ f[:-shift]) <= distance) & (f[shift:] != f[:-shift])
            out_a.append(f[:-shift][hit])
            out_b.append(f[shift:][hit])
        return (np.concatenate(x) if x else np.empty(0, np.uint64) for x in (out_a, out_b))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        kept: list = []
        for batch in batches:
            cols = [batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)]
            if not len(cols[0]):
                continue
            last = np.flatnonzero(cols[0] != cols[0][-1])
            if len(last) == 0 and (not kept or kept[-1][0][-1] == cols[0][0]):  # one cell so far
                kept.append(cols)
                continue
            end = last[-1] + 1 if len(last) else 0
            whole = [np.concatenate([*(k[i] for k in kept), cols[i][:end]]) for i in range(3)]
            kept = [[x[end:] for x in cols]]
            a, b = links(*whole, np)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])
        if kept:
            whole = [np.concatenate([k[i] for k in kept]) for i in range(3)]
            if len(whole[0]):
                a, b = links(*whole, np)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return run


def near_links(fps: DataFrame, distance: int = 3, hot: int = 8192, max_hot: int = 50_000, small: int = 48) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect exactly those within the distance (3 at most), directly or in chains.

    Grid join over cells(): rows are dealt by cell, sorted, and compared exactly by vectorised XOR and bit count. A cell's links are
    emitted as a spanning forest once it has over `small` rows, so no group is expanded into all its pairs. Cells owned by
    over `hot` fingerprints are split into k blocks by hash, and every pair of blocks is dealt on its own, so no task gets
    a whole hot cell and no pair is lost. The list of hot cells is broadcast: it has at most 2 * (number of
    fingerprints) / hot entries, and hot grows with the input so that this never exceeds max_hot."""
    if distance > 3:
        raise ValueError("the grid of half vectors is complete for distances up to 3")
    ship(fps.sparkSession)
    n = fps.count()
    hot = max(hot, -(-2 * n // max_hot))
    rows = cells(fps)
    big = rows.where("own").groupBy("cell").count().where(F.col("count") > hot)
    big = materialize(big.select(F.col("cell").alias("hot_cell"), F.ceil(F.col("count") / hot).cast("int").alias("k")), "hot_cells")
    if not big.isEmpty():
        rows = rows.join(F.broadcast(big), F.col("cell") == F.col("hot_cell"), "left")
        chunk = F.expr("pmod(xxhash64(fp), k)")
        blocks = F.expr("transform(sequence(0, k - 1), j -> struct(least(j, chunk) as lo, greatest(j, chunk) as hi))")
        rows = rows.withColumn("chunk", chunk).withColumn("blocks", F.when(F.col("k").isNull(), F.array(F.struct(F.lit(0).cast("bigint").alias("lo"), F.lit(0).cast("bigint").alias("hi")))).otherwise(blocks))
        rows = rows.select("cell", "fp", "own", "k", F.explode("blocks").alias("x"))
        rows = rows.select(F.when(F.col("k").isNull(), F.col("cell")).otherwise(F.xxhash64("cell", "x.lo", "x.hi")).alias("cell"), "fp", "own")
    dealt = rows.repartition("cell").sortWithinPartitions("cell", "fp")
    return dealt.mapInArrow(_block_links(distance, small), "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = 3, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over fingerprints within the distance.

    Equal fingerprints are one node, so exact copies cost one row each whatever their number. Null text counts as empty; texts
    without words have fingerprint 0 and link like any other. A null doc_id keeps its row and is never a component_id unless
    all ids of the component are null. Repeated rows each stay. An empty table gives no rows; other columns are not read."""
    sigs = materialize(fingerprints(docs, shingle, id_col, text_col), "simhash")
    nodes = materialize(sigs.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    roots = components(near_links(nodes.select("fp"), distance))
    of = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    low = of.groupBy("root").agg(F.min("rep").alias("component_id"))
    of = of.join(low, "root").select(F.col("fp").alias("f"), "component_id")
    return sigs.join(of, F.col("fp") == F.col("f")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
