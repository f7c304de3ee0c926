"""Pre-aggregates: definition, full and incremental refresh on mergeable columns, and matching of queries."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An aggregate: (function, column, alias); function is count, sum, avg, min, max, count_distinct or approx_distinct; column '*' with count.
Agg = tuple[str, str, str]


@dataclass(frozen=True)
class Spec:
    """SELECT group_by, aggs FROM source WHERE filters GROUP BY group_by; filters are (column, SQL condition) pairs.

    A group column may be an expression, given in exprs as (name, SQL); an aggregate's column may be any SQL expression."""

    source: str
    group_by: tuple[str, ...]
    aggs: tuple[Agg, ...]
    filters: tuple[tuple[str, str], ...] = ()
    exprs: tuple[tuple[str, str], ...] = ()

    def rows(self, df: DataFrame) -> DataFrame:
        """The rows that count, with the group columns that are expressions; of rows and their conditions the source's own columns come first."""
        for _, cond in self.filters:
            df = df.where(cond)
        return df.withColumns({n: F.expr(e) for n, e in self.exprs}) if self.exprs else df

    def run(self, df: DataFrame) -> DataFrame:
        """Straight from the source."""
        df = self.rows(df)
        fn = {"count": lambda c: F.count(F.lit(1)) if isinstance(c, str) else F.count(c), "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count_distinct": F.count_distinct, "approx_distinct": lambda c: F.hll_sketch_estimate(F.hll_sketch_agg(c))}
        return df.groupBy(*self.group_by).agg(*[fn[f](c if c == "*" else F.expr(c)).alias(a) for f, c, a in self.aggs])


def _states(aggs: tuple[Agg, ...]) -> list[tuple[str, str]]:
    """(kind, column) of the mergeable columns that the aggregates need."""
    need = {"count": ("count",), "sum": ("sum",), "avg": ("sum", "count"), "min": ("min",), "max": ("max",), "count_distinct": ("set",), "approx_distinct": ("hll",)}
    return sorted({(k, c) for f, c, _ in aggs for k in need[f]})


def _name(kind: str, col: str) -> str:
    return f"__{kind}_{'all' if col == '*' else col if re.fullmatch(r'\w+', col) else f'x{zlib.crc32(col.encode()):08x}'}"


_MAKE = {"count": lambda c: F.count(F.lit(1)) if isinstance(c, str) else F.count(c), "sum": F.sum, "min": F.min, "max": F.max, "set": F.collect_set, "hll": F.hll_sketch_agg}
_MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max, "set": lambda c: F.array_distinct(F.flatten(F.collect_list(c))), "hll": F.hll_union_agg}


@dataclass
class View:
    """A pre-aggregate: its definition and a DataFrame of mergeable columns per group. Nulls follow SQL: COUNT(c) and SUM skip them."""

    name: str
    spec: Spec
    data: DataFrame | None = None
    made_of: tuple | None = None
    table: str | None = None

    def state(self, df: DataFrame) -> DataFrame:
        return self.spec.rows(df).groupBy(*self.spec.group_by).agg(*[_MAKE[k](c if c == "*" else F.expr(c)).alias(_name(k, c)) for k, c in _states(self.spec.aggs)])

    def merge(self, a: DataFrame, b: DataFrame, group_by: tuple[str, ...] | None = None) -> DataFrame:
        return self.rollup(a.unionByName(b), self.spec.group_by if group_by is None else group_by)

    def rollup(self, df: DataFrame, group_by: tuple[str, ...]) -> DataFrame:
        return df.groupBy(*group_by).agg(*[_MERGE[k](_name(k, c)).alias(_name(k, c)) for k, c in _states(self.spec.aggs)])

    def refresh(self, df: DataFrame) -> View:
        """Full: the state of all rows."""
        self.data = self.state(df)
        return self

    def add(self, batch: DataFrame) -> View:
        """Incremental: only the batch is aggregated, then merged by group."""
        self.data = self.state(batch) if self.data is None else self.merge(self.data, self.state(batch))
        return self

    def answers(self, q: Spec) -> str | None:
        """None if this view answers the query, else why not."""
        if q.source != self.spec.source:
            return "another source"
        mine = dict(self.spec.exprs)
        if not set(q.group_by) <= set(self.spec.group_by) or any(mine.get(n) != e for n, e in q.exprs) or any(n in mine for n in q.group_by if n not in dict(q.exprs)):
            return "groups by columns that the view lacks"
        extra = [f for f in q.filters if f not in self.spec.filters]
        if not set(self.spec.filters) <= set(q.filters):
            return "the view leaves out rows that the query needs"
        if any(c not in self.spec.group_by for c, _ in extra):
            return "filters on columns that the view lacks"
        if missing := set(_states(q.aggs)) - set(_states(self.spec.aggs)):
            return f"lacks {sorted(missing)}"
        if any(f == "count_distinct" for f, _, _ in q.aggs) and set(q.group_by) != set(self.spec.group_by):
            return "exact distinct counts are kept at the view's own grain"
        return None

    def run(self, q: Spec) -> DataFrame:
        """The query, from the view."""
        if why := self.answers(q):
            raise ValueError(f"{self.name}: {why}")
        df = self.data
        for f in q.filters:
            if f not in self.spec.filters:
                df = df.where(f[1])
        df = self.rollup(df, q.group_by)
        col = lambda k, c: F.col(_name(k, c))
        get = {"count": lambda c: col("count", c), "sum": lambda c: col("sum", c), "avg": lambda c: F.try_divide(col("sum", c), col("count", c)), "min": lambda c: col("min", c), "max": lambda c: col("max", c), "count_distinct": lambda c: F.size(col("set", c)).cast("long"), "approx_distinct": lambda c: F.hll_sketch_estimate(col("hll", c))}
        return df.select(*q.group_by, *[get[f](c).alias(a) for f, c, a in q.aggs])


def rewrite(q: Spec, views: list[View], source: DataFrame) -> tuple[DataFrame, str]:
    """The query from the first view that answers it (the one with fewest group columns), else from the source; and which it was."""
    for v in sorted(views, key=lambda v: len(v.spec.group_by)):
        if v.data is not None and v.answers(q) is None:
            return v.run(q), v.name
    return q.run(source), q.source
