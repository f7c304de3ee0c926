"""Near-duplicates by SimHash and the Jaccard similarity of their word shingles: candidates of the fingerprints' grid, an exact prefix-filter join for those that differ in more bits, and components."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import components, free, give_back, make_room, materialize, ship, whole_text

_SLOTS = 1 << 23
_BITMAP = 1 << 15  # bits of one of Spark's bitmaps


def _hashes(text: str | None, words: int):
    """The sorted distinct XXH64 of a text's shingles, which are those of simhash.fingerprints."""
    return _distinct(simhash.shingle_hashes(text, words))


def _distinct(hashes):
    import numpy as np

    return np.unique(np.concatenate([np.empty(0, np.uint64), *hashes]))


def _node(hashes) -> int:
    from xxhash import xxh64_intdigest

    x = xxh64_intdigest(hashes.tobytes(), 7)
    return x - (1 << 64) if x >> 63 else x


def _histogram(hashes) -> bytes:
    """How many hashes have each last byte, 255 at most: two sets' histograms differ in sum by no more than the sets do."""
    import numpy as np

    return np.minimum(np.bincount((hashes & np.uint64(255)).astype(np.int64), minlength=256), 255).astype(np.uint8).tobytes()


def _whole(batches):
    """Batches sorted by their first column -> lists of numpy columns, none of which ends inside a run of equal first values."""
    import numpy as np

    kept: list = []
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(cols[0]):
            continue
        last = np.flatnonzero(cols[0] != cols[0][-1])
        if len(last) == 0 and (not kept or kept[-1][0][-1] == cols[0][0]):
            kept.append(cols)
            continue
        end = last[-1] + 1 if len(last) else 0
        yield [np.concatenate([*(k[i] for k in kept), cols[i][:end]]) for i in range(len(cols))]
        kept = [[x[end:] for x in cols]]
    if kept:
        yield [np.concatenate([k[i] for k in kept]) for i in range(len(kept[0]))]


def _common(docs: DataFrame, words: int, sample: int, share: int, most: int):
    """(hashes, counts) of shingles that several texts of a sample hold: a share of all texts, `sample` at least. They only order the prefixes: no result depends on them."""
    import numpy as np

    def run(batches):
        import numpy as np
        import pyarrow as pa

        make_room()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *(_hashes(x.as_py(), words) for x in batch.column(0))]).view(np.int64))], names=["h"])

    k = min(share, -(-max(docs.count(), 1) // sample))
    some = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(k)) == 0).mapInArrow(run, "h long")
    got = some.groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(most).toArrow()
    h, n = got.column(0).to_numpy().view(np.uint64), got.column(1).to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def _apart(x, y):
    """Sums of the differences of two arrays of histograms, row by row."""
    import numpy as np

    return np.abs(x.astype(np.int16) - y.astype(np.int16)).sum(axis=1, dtype=np.int64)


class _Bounds:
    """What sizes, places and histograms of two sets allow of a similarity of over / under; all of it holds for every similar pair."""

    def __init__(self, similarity: float):
        share = Fraction(str(similarity))
        self.over, self.under = share.numerator, share.denominator

    def prefix(self, n: int) -> int:
        return n - -(-self.over * n // self.under) + 1

    def sizes(self, small, large):
        return self.under * small >= self.over * large

    def places(self, n, at, m, to):
        """Two sets that share no token before these places have at most n - at and m - to tokens in common."""
        both = -(-self.over * (n + m) // (self.over + self.under))
        return (n - at >= both) & (m - to >= both)

    def histograms(self, x, y, n, m):
        return (self.under + self.over) * _apart(x, y) <= (self.under - self.over) * (n + m)

    def sets(self, x, y) -> bool:
        import numpy as np

        both = len(np.intersect1d(x, y, assume_unique=True))
        return self.under * both >= self.over * (len(x) + len(y) - both)


def _by_fingerprint(sigs: DataFrame, distance: int) -> DataFrame:
    """(node, fp) -> distinct (a, b): pairs that join, directly or in chains, all nodes whose fingerprints differ in that many bits or fewer.

    The links are those of the SimHash operator's grid; of the nodes of one fingerprint the smallest is paired with the others and stands for them."""
    own = materialize(sigs.select("node", "fp").distinct(), "shingle_fingerprints")
    of = materialize(own.groupBy("fp").agg(F.min("node").alias("node")), "simhash")
    links = simhash.near_links(of.select("fp"), distance)
    for side in ("a", "b"):
        links = links.join(of.select(F.col("fp").alias(side), F.col("node").alias(f"node_{side}")).hint("merge"), side)
    same = own.join(of.withColumnRenamed("node", "first").hint("merge"), "fp").select(F.col("first").alias("node_a"), F.col("node").alias("node_b"))
    both = links.select("node_a", "node_b").union(same).where("node_a <> node_b")
    return both.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def _neighbours(rows: DataFrame, bounds: _Bounds, reach: int) -> DataFrame:
    """(token, node, n, at) -> distinct (a, b): of each row of a token and the `reach` next ones by size what the bounds allow.

    Rows are dealt by ranges of (token, n, node), so a token's rows may be in several tasks; what is next to one another across them is left to _others."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        kept = None
        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            if kept is not None:
                cols = [np.concatenate(x) for x in zip(kept, cols, strict=True)]
            token, node, n, at = cols
            old = 0 if kept is None else len(kept[0])
            found = []
            for shift in range(1, reach + 1):
                i = np.arange(max(0, old - shift), len(token) - shift)
                j = i + shift
                ok = (token[i] == token[j]) & (node[i] != node[j]) & bounds.sizes(n[i], n[j]) & bounds.places(n[i], at[i], n[j], at[j])
                found.append(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])])[:, ok])
            x = np.unique(np.concatenate(found, axis=1), axis=1)
            kept = [c[-reach:] for c in cols]
            yield pa.RecordBatch.from_arrays([pa.array(x[0]), pa.array(x[1])], names=["a", "b"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(n, "token", "n", "node").sortWithinPartitions("token", "n", "node").mapInArrow(run, "a long, b long").distinct()


def _dealt(rows: DataFrame, hot: int, max_hot: int) -> DataFrame:
    """rows with key and chunk, so that all rows of a token share a key; those of a token of over `hot` rows go in chunks, and each pair of chunks has a key.

    The list of such tokens is broadcast: it has at most max_hot entries, as hot grows with the rows where it must."""
    counts = rows.groupBy("token").count()
    n, most = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    hot = max(hot, -(-n // max_hot))
    if most <= hot:
        return rows.select(F.col("token").alias("key"), "*", F.lit(0).cast("long").alias("chunk"), F.lit(True).alias("whole"))
    big = materialize(counts.where(F.col("count") > hot).select(F.col("token").alias("hot_token"), F.ceil(F.col("count") / hot).cast("int").alias("k")), "hot_tokens")
    rows = rows.join(F.broadcast(big), F.col("token") == F.col("hot_token"), "left").withColumn("chunk", F.coalesce(F.expr("pmod(xxhash64(node), k)"), F.lit(0)))
    pairs = F.expr("transform(sequence(0, k - 1), j -> struct(least(j, chunk) as lo, greatest(j, chunk) as hi))")
    one = F.array(F.struct(F.lit(0).cast("bigint").alias("lo"), F.lit(0).cast("bigint").alias("hi")))
    rows = rows.withColumn("x", F.explode(F.when(F.col("k").isNull(), one).otherwise(pairs)))
    key = F.when(F.col("k").isNull(), F.col("token")).otherwise(F.xxhash64("token", "x.lo", "x.hi"))
    return rows.select(key.alias("key"), "token", "node", "n", "at", "root", "chunk", (F.col("x.lo") == F.col("x.hi")).alias("whole"))


_MIXED = "key long, node long, n int, at int, root long, chunk long, whole boolean"
_MIXED_NAMES = ("key", "node", "n", "at", "root", "chunk", "whole")


def _candidates(cols, bounds: _Bounds):
    """(i, j) of pairs of rows of a key and of different roots that sizes and places allow, shift by shift; rows ascend by size, so a row that
    fails by size has no partner further on."""
    import numpy as np

    key, node, n, at, root, chunk, whole = cols
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    mixed = np.minimum.reduceat(root, start) != np.maximum.reduceat(root, start)
    i = np.flatnonzero(np.repeat(mixed, np.diff(np.append(start, len(key)))))
    shift = 0
    while len(i):
        shift += 1
        i = i[i + shift < len(key)]
        i = i[(key[i] == key[i + shift]) & bounds.sizes(n[i], n[i + shift])]
        j = i + shift
        hit = (root[i] != root[j]) & (whole[i] | (chunk[i] != chunk[j])) & bounds.places(n[i], at[i], n[j], at[j])
        if hit.any():
            yield i[hit], j[hit]


def _mixed(rows: DataFrame, bounds: _Bounds, hot: int, max_hot: int) -> DataFrame:
    """(token, node, n, at, root) -> a table of the rows, by key, that have a partner of another root which sizes and places allow."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for cols in _whole(batches):
            mark = np.zeros(len(cols[0]), bool)
            for i, j in _candidates(cols, bounds):
                mark[i] = mark[j] = True
            yield pa.RecordBatch.from_arrays([pa.array(c[mark]) for c in cols], names=list(_MIXED_NAMES))

    dealt = _dealt(rows, hot, max_hot).select(*_MIXED_NAMES)
    return materialize(dealt.repartition("key").sortWithinPartitions("key", "n", "node").mapInArrow(run, _MIXED), "shingle_mixed")


def _others(some: DataFrame, bars: DataFrame, bounds: _Bounds) -> DataFrame:
    """_mixed rows -> distinct (a, b, root_a, root_b): all their pairs that histograms allow too. Other pairs never leave the task that compares them."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for cols in _whole(batches):
            *cols, bars = cols
            node, n, root = cols[1], cols[2], cols[4]
            bars = np.frombuffer(b"".join(bars), np.uint8).reshape(-1, 256)
            found = []
            for i, j in _candidates(cols, bounds):
                for k in range(0, len(i), 1 << 16):
                    x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                    ok = bounds.histograms(bars[x], bars[y], n[x], n[y])
                    found.append(np.stack([node[x], node[y], root[x], root[y]])[:, ok])
            if found:
                x = np.concatenate(found, axis=1)
                x = np.unique(np.where(x[0] < x[1], x, x[[1, 0, 3, 2]]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in x], names=["a", "b", "root_a", "root_b"])

    rows = some.join(bars.select(F.col("node").alias("of"), "bars").hint("merge"), F.col("node") == F.col("of")).select(*_MIXED_NAMES, "bars")
    return rows.repartition("key").sortWithinPartitions("key", "n", "node").mapInArrow(run, "a long, b long, root_a long, root_b long").distinct()


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, sample: int = 20_000, share: int = 16, most: int = 200_000, distance: int = 3, reach: int = 3, hot: int = 8192, max_hot: int = 50_000, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """doc_id, row, root and component_id of every row: row is row_col (null without one), root tells the components apart, and component_id is the smallest doc_id reachable over texts whose sets of shingles have that Jaccard similarity or more.

    The method is SimHash over shingles of so many words: texts whose fingerprints differ in `distance` bits or fewer, as the operator's grid
    joins them, are candidates, and their sets of shingles are compared. Similar texts can differ in more bits than any selective grid covers, so an
    exact join supplies the rest of the pairs. It loses none: in one order of all shingles, two such sets share one of their first n - ceil(similarity * n) + 1, and the first that
    they share stands early enough in both. The order puts those that are common in a sample last. Texts with equal sets (64-bit hashes)
    are one node, and a task gives the shingles of a node once. Its candidates are pairs within a shingle's nodes; together with the fingerprints' each
    node with the next few by size, then all pairs that the links so far leave in different components, so a large group is not expanded into its pairs.
    Candidates whose sizes, places or histograms of hashes rule the similarity out are dropped; the sets of all others are compared whole.
    Null text counts as empty, and all texts without words are one node; a null doc_id is never a component_id unless all
    ids of the component are null."""
    ship(docs.sparkSession)
    bounds = _Bounds(similarity)
    row = F.col(row_col) if row_col else F.lit(None)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), row.cast("long").alias("row"), whole_text(text_col).alias("text"))
    common, counts = _common(own, words, sample, share, most)

    def sign(batches):
        import numpy as np
        import pyarrow as pa

        make_room()
        seen: set[int] = set()
        for batch in batches:
            node, size, fp, first, bars = [], [], [], [], []
            for x in batch.column(2):
                all_of = list(simhash.shingle_hashes(x.as_py(), words))
                h = _distinct(all_of)
                k, n = _node(h), len(h)
                node.append(k)
                size.append(n)
                fp.append(simhash.majority(all_of))
                if k in seen:
                    first.append(None)
                    bars.append(None)
                    continue
                seen.add(k)
                bars.append(_histogram(h))
                rank = np.zeros(n, np.int64)
                if n and len(common):
                    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                    rank = np.where(common[at] == h, counts[at], 0)
                first.append(h[np.lexsort((h, rank))[: bounds.prefix(n)]].view(np.int64) if n else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node, pa.int64()), pa.array(size, pa.int32()), pa.array(fp, pa.int64()), pa.array(first, pa.list_(pa.int64())), pa.array(bars, pa.binary())], names=["doc_id", "row", "node", "n", "fp", "prefix", "bars"])
        give_back()

    def shared(batches):
        import numpy as np
        import pyarrow as pa

        for cols in _whole(batches):
            token, node = cols[:2]
            once = np.concatenate([[True], (token[1:] != token[:-1]) | (node[1:] != node[:-1])])
            cols = [c[once] for c in cols]
            token = cols[0]
            same = token[1:] == token[:-1]
            many = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            yield pa.RecordBatch.from_arrays([pa.array(c[many]) for c in cols], names=["token", "node", "n", "at"])

    sigs = materialize(own.mapInArrow(sign, "doc_id long, row long, node long, n int, fp long, prefix array<long>, bars binary"), "shingle_prefixes")
    rows = sigs.select("node", "n", F.posexplode("prefix").alias("at", "token")).select("token", "node", "n", "at")
    rows = rows.repartition("token").sortWithinPartitions("token", "n", "node")
    rows = materialize(rows.mapInArrow(shared, "token long, node long, n int, at int"), "shingle_rows")
    bars = materialize(sigs.where("bars is not null").select("node", "bars", "n").dropDuplicates(["node"]), "shingle_bars")

    def close(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, 256) for i in (2, 4))
                hit = pa.array(bounds.histograms(x, y, batch.column(3).to_numpy().astype(np.int64), batch.column(5).to_numpy().astype(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(hit), batch.column(1).filter(hit)], names=["a", "b"])

    def both(of: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
        """of (a, b, ..) with the columns of either node."""
        rest = [c for c in of.columns if c not in ("a", "b")]
        for side in ("a", "b"):
            of = of.join(sets.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]).hint("merge"), side)
        return of.select("a", "b", *[f"{c}_{side}" for side in ("a", "b") for c in columns], *rest)

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Those of the pairs whose whole sets are similar. A set is made again, from the text, if its node's bit of a fixed map is set."""
        import numpy as np

        slot = F.explode(F.array("a", "b")).alias("x")
        bit = pairs.select(slot).select(F.col("x").bitwiseAND(_SLOTS - 1).alias("bit"))
        maps = bit.groupBy(F.expr(f"bit div {_BITMAP}").alias("part")).agg(F.bitmap_construct_agg(F.expr(f"bit % {_BITMAP}")).alias("bits")).collect()
        if not maps:
            return pairs
        wanted = np.zeros(_SLOTS // 8, np.uint8)
        for m in maps:
            wanted[m.part * _BITMAP // 8 : (m.part + 1) * _BITMAP // 8] = np.frombuffer(bytes(m.bits), np.uint8)

        def sets(batches):
            import pyarrow as pa

            seen: set[int] = set()
            for batch in batches:
                node, whole = [], []
                for x in batch.column(0):
                    h = _hashes(x.as_py(), words)
                    k = _node(h)
                    slot = k & (_SLOTS - 1)
                    if k not in seen and wanted[slot >> 3] >> (slot & 7) & 1:
                        seen.add(k)
                        node.append(k)
                        whole.append(h.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(whole, pa.binary())], names=["node", "hashes"])
            give_back()

        names = [c for c in pairs.columns if c not in ("a", "b")]

        def confirm(batches):
            import numpy as np
            import pyarrow as pa

            for batch in batches:
                hit = pa.array([bounds.sets(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(batch.column(2), batch.column(3), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(i).filter(hit) for i in (0, 1, *range(4, 4 + len(names)))], names=["a", "b", *names])

        kept = materialize(own.select("text").mapInArrow(sets, "node long, hashes binary").dropDuplicates(["node"]), "shingle_sets")
        links = materialize(both(pairs, kept, "hashes").mapInArrow(confirm, ", ".join(f"{c} long" for c in ("a", "b", *names))), "shingle_links")
        free(pairs, kept)
        return links

    first = _by_fingerprint(sigs, distance).union(_neighbours(rows, bounds, reach)).distinct()
    near = both(first, bars, "bars", "n").mapInArrow(close, "a long, b long")
    roots = materialize(components(confirmed(materialize(near, "shingle_pairs"))), "shingle_roots")
    of = rows.join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    rest = materialize(of.select("token", "node", "n", "at", F.coalesce("root", "node").alias("root")), "shingle_rooted")
    free(rows)
    some = _mixed(rest, bounds, hot, max_hot)
    free(rest)
    others = materialize(_others(some, bars, bounds), "shingle_pairs")
    free(some, bars)
    more = confirmed(others)
    joined = components(more.select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))).select(F.col("node").alias("old"), F.col("root").alias("new"))
    nodes = sigs.groupBy("node").agg(F.min("doc_id").alias("rep")).join(roots.withColumnRenamed("node", "k"), F.col("node") == F.col("k"), "left").select("node", "rep", F.coalesce("root", "node").alias("root"))
    nodes = materialize(nodes.join(joined, F.col("root") == F.col("old"), "left").select("node", "rep", F.coalesce("new", "root").alias("root")), "shingle_nodes")
    low = nodes.groupBy("root").agg(F.min("rep").alias("component_id"))
    of = nodes.join(low, "root").select(F.col("node").alias("k"), "root", "component_id")
    return sigs.select("doc_id", "row", "node").join(of, F.col("node") == F.col("k")).select("doc_id", "row", "root", "component_id")
