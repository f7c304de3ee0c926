"""Nearest neighbours by largest inner product: stable projections, a kd-tree on them, and a chi-square stopping test."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, ship


def chi2_quantile(p: float, m: int) -> float:
    """Quantile of the chi-square distribution with an even number m of degrees of freedom."""
    if m % 2:
        raise ValueError("m must be even")

    def cdf(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))

    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return high


def kd_leaves(points, leaf: int):
    """Row numbers of each leaf of a kd-tree: nodes are halved at the median of their widest dimension."""
    import numpy as np

    todo, leaves = [np.arange(len(points))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            leaves.append(rows)
            continue
        p = points[rows]
        order = np.argpartition(p[:, np.argmax(p.max(axis=0) - p.min(axis=0))], len(rows) // 2)
        todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return leaves


class Block:
    """One block's vectors, as a kd-tree over their projections.

    Inner products become distances by one more coordinate, sqrt(bound^2 - |x|^2), with 0 for queries: then
    |x' - q'|^2 = bound^2 + |q|^2 - 2 q.x. Equal vectors are one point. Of each id it keeps at most k rows, and of those the 2k with the smallest
    ids: whichever id a query has, k of the best others are among them, as ties go to smaller ids."""

    def __init__(self, ids, vectors, bound: float, k: int, m: int = 8, leaf: int = 128, seed: int = 7):
        import numpy as np

        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        _, first, inverse = np.unique(np.ascontiguousarray(vectors + 0.0).view(f"V{vectors.itemsize * vectors.shape[1]}").ravel(), return_index=True, return_inverse=True)
        by = np.argsort(inverse, kind="stable")  # by point, then id
        own = ids[by]
        fresh = np.concatenate([[True], (own[1:] != own[:-1]) | (inverse[by][1:] != inverse[by][:-1])]) if len(own) else np.empty(0, bool)
        nth = np.arange(len(own)) - np.maximum.accumulate(np.where(fresh, np.arange(len(own)), 0))  # of its id in its point
        by, own = by[nth < k], own[nth < k]
        begin = np.concatenate([[0], np.cumsum(np.bincount(inverse[by], minlength=len(first)))])
        self.members = [own[a : min(b, a + 2 * k)] for a, b in zip(begin[:-1], begin[1:], strict=True)]
        # a point with one id only is no candidate for a query of that id
        self.only = np.array([x[0] for x in self.members]) if len(first) else np.empty(0, np.int64)
        self.mixed = np.array([x[0] != x[-1] for x in self.members], bool)
        self.x = vectors[first].astype(np.float64)
        self.bound2 = bound * bound
        self.g = np.random.default_rng(seed).standard_normal((self.x.shape[1] + 1, m))
        extra = np.sqrt(np.maximum(self.bound2 - (self.x**2).sum(axis=1), 0))
        self.p = np.column_stack([self.x, extra]) @ self.g
        self.leaves = kd_leaves(self.p, leaf)
        self.low = np.array([self.p[r].min(axis=0) for r in self.leaves])
        self.high = np.array([self.p[r].max(axis=0) for r in self.leaves])
        self.size = np.array([len(r) for r in self.leaves])
        self.m = m

    def search(self, ids, q, k: int, confidence: float):
        """Point numbers and inner products of about the k best points of each query, as (queries, k) arrays; -1 pads. Points that hold a query's own id alone are left out.

        Leaves are taken by the distance of their boxes from the projected query, some at a time; all points of a leaf are
        verified on the original vectors. A query stops when the next box is so far off that, by the chi-square law of
        projected distances, a nearer point than its k-th best would lie beyond it with a chance of at most 1 - confidence."""
        import numpy as np

        n_q, n_l = len(q), len(self.leaves)
        pq = q @ self.g[:-1]
        gap = np.zeros((n_q, n_l))
        for d in range(self.m):
            gap += np.maximum(np.maximum(self.low[None, :, d] - pq[:, d, None], pq[:, d, None] - self.high[None, :, d]), 0) ** 2
        order = np.argsort(gap, axis=1, kind="stable")
        gap = np.take_along_axis(gap, order, axis=1)
        limit = chi2_quantile(confidence, self.m)
        q2 = (q**2).sum(axis=1)
        best = np.full((n_q, k), -np.inf)
        point = np.full((n_q, k), -1)
        active, width, step = np.arange(n_q), int(self.size.max()), 2
        for r in range(0, n_l, step):
            scores = np.full((len(active), width * step), -np.inf)
            points = np.full((len(active), width * step), -1)
            for j in range(min(step, n_l - r)):
                at = order[active, r + j]
                by = np.argsort(at, kind="stable")
                cuts = np.flatnonzero(np.diff(at[by])) + 1
                for rows in np.split(by, cuts):
                    own = self.leaves[at[rows[0]]]
                    found = q[active[rows]] @ self.x[own].T
                    found[(self.only[own] == ids[active[rows], None]) & ~self.mixed[own]] = -np.inf
                    scores[rows, j * width : j * width + len(own)] = found
                    points[rows, j * width : j * width + len(own)] = own
            scores = np.concatenate([best[active], scores], axis=1)
            points = np.concatenate([point[active], points], axis=1)
            top = np.argpartition(-scores, k - 1, axis=1)[:, :k]
            best[active] = np.take_along_axis(scores, top, axis=1)
            point[active] = np.take_along_axis(points, top, axis=1)
            if r + step < n_l:
                worst = self.bound2 + q2[active] - 2 * best[active].min(axis=1)
                active = active[~(gap[active, r + step] >= np.maximum(worst, 0) * limit)]
            if not len(active):
                break
        return point, best


def _neighbours(block: Block, query_ids, q, k: int, confidence: float):
    """Rows (query, id, score) of a block: at most k per query, ties to smaller ids. Scores are sums in one fixed order."""
    import numpy as np

    spare = 4
    q = q.astype(np.float64)
    point, best = block.search(query_ids, q, min(k + spare, len(block.x)), confidence)
    out_q, out_i, out_s = [], [], []
    for qid, row, s, v in zip(query_ids, point, best, q, strict=True):
        row = row[(row >= 0) & (s > -np.inf)]
        score = (block.x[row] * v).sum(axis=1)
        ids = [block.members[p] for p in row]
        s = np.repeat(score, [len(i) for i in ids])
        i = np.concatenate(ids) if ids else np.empty(0, np.int64)
        s, i = s[i != qid], i[i != qid]
        top = np.lexsort((i, -s))[:k]
        out_q.append(np.full(len(top), qid))
        out_i.append(i[top])
        out_s.append(s[top])
    return out_q, out_i, out_s


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v, dim): rows with an id and a vector without null or non-finite components that isn't zero."""
    v = F.col(vec_col).cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).where(ok).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), F.size(v).alias("dim"))


def blocks_of(n: int, rows: int, tasks: int, least: int = 4096) -> int:
    """Parts of at most `rows` rows each; more, of `least` rows or so, while that gives up to `tasks` of them."""
    return max(1, -(-n // rows), min(tasks, n // least))


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, block_rows: int = 65536, query_rows: int = 16384, confidence: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k rows nearest to each query (rows whose id is divisible by `every`): query_id, rank, vec_id, score.

    Vectors are dealt by hash into blocks of at most block_rows, queries into chunks of at most query_rows, and each (block, chunk)
    is one group of bounded size: its task builds the block's kd-tree and searches it for the chunk, so every row is
    indexed and every query meets every block. A block returns k rows per query, of which the k best stay. The query set grows with the
    table, so the work is its size times the table's, whatever the index saves: where vectors are spread evenly, as in the synthetic table,
    the stopping test lets only about 2 % of the leaves go (README).
    Rows of the query's own id are no candidates; other rows of equal id are each one. Vectors meet only vectors of their own length. Null
    ids, null or zero vectors and those with null or non-finite components take no part; of several vectors of a query's id the smallest
    (component by component) is the query; an empty table gives no rows; other columns are not read.
    """
    ship(vectors.sparkSession)
    base = materialize(usable(vectors, id_col, vec_col), "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    n, n_q, longest = base.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0), F.max(norm)).first()
    tasks = 4 * int(vectors.sparkSession.sparkContext.defaultParallelism)
    blocks, chunks = blocks_of(n, block_rows, tasks), max(1, -(-n_q // query_rows))
    bound = math.sqrt(longest or 0.0) * (1 + 1e-12)
    of = lambda seed, parts, *by: F.pmod(F.xxhash64(F.lit(seed), *by), F.lit(parts)).cast("int")
    left = base.withColumn("block", of("block", blocks, "vec_id", "v")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    right = base.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    right = right.withColumn("chunk", of("chunk", chunks, "vec_id")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(rows, queries):
        import numpy as np
        import pyarrow as pa

        def matrix(t):
            v = t.column("v").combine_chunks()
            return t.column("vec_id").to_numpy(), v.flatten().to_numpy().reshape(t.num_rows, -1)

        parts = ([], [], [])
        if rows.num_rows and queries.num_rows:
            block = Block(*matrix(rows), bound, k)
            ids, q = matrix(queries)
            for at in range(0, len(ids), 1024):
                for into, got in zip(parts, _neighbours(block, ids[at : at + 1024], q[at : at + 1024], k, confidence), strict=True):
                    into.extend(got)
        cols = [np.concatenate(p) if p else np.empty(0, t) for p, t in zip(parts, (np.int64, np.int64, np.float64), strict=True)]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    keys = ("block", "chunk", "dim")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
