"""URL filters: host and path rules, and gradient-boosted trees on lexical features for urls that no rule fits. DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Fixed values: (verdict, rule); the part before the first slash is the host, the rest the beginning of the path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
FEATURES = ("length", "host_length", "depth", "digit_ratio", "entropy", "params", "hyphens", "labels", "path_length", "suffix_rate", "path_rate")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: str = "url") -> Column:
    """What follows the first :// up to /, ?, # or the end, with A-Z lower-cased; null or without ://: empty."""
    rest = F.substring_index(F.col(url), "://", 1)
    after = F.when(F.contains(url, F.lit("://")), F.substring(F.col(url), F.length(rest) + 4, F.length(url))).otherwise("")
    return F.coalesce(F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path(url: str = "url") -> Column:
    """What follows the host up to ?, # or the end; empty where host() has nothing to look at."""
    rest = F.substring_index(F.col(url), "://", 1)
    after = F.when(F.contains(url, F.lit("://")), F.substring(F.col(url), F.length(rest) + 4, F.length(url))).otherwise("")
    return F.coalesce(F.regexp_extract(after, r"(?s)^[^/?#]*+([^?#]*)", 1), F.lit(""))


def apply_rules(rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) over columns host and path; a rule fits its host and all subdomains where the path starts with its own; the longest wins."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: len(x[1])):
        h, _, p = r.partition("/")
        fits = ((F.col("host") == h) | F.endswith(F.col("host"), F.lit("." + h))) & F.startswith(F.col("path"), F.lit("/" + p))
        text, verdict = F.when(fits, F.lit(r)).otherwise(text), F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


def _entropy(x: Column) -> Column:
    """Shannon entropy of all characters, in bits; empty: 0. One fold over the sorted characters, run by run."""
    n = F.length(x).cast("double")
    chars = F.array_sort(F.filter(F.split(x, ""), lambda c: c != ""))
    weigh = lambda k: k * F.log2(F.greatest(k, F.lit(1.0)))

    def add(s: Column, c: Column) -> Column:
        same = s["c"] == c
        return F.struct(c.alias("c"), F.when(same, s["k"] + 1.0).otherwise(F.lit(1.0)).alias("k"), F.when(same, s["sum"]).otherwise(s["sum"] + weigh(s["k"])).alias("sum"))

    zero = F.struct(F.lit("").alias("c"), F.lit(0.0).alias("k"), F.lit(0.0).alias("sum"))
    return F.when(n > 0, F.aggregate(chars, zero, add, lambda s: F.log2(n) - (s["sum"] + weigh(s["k"])) / n)).otherwise(0.0)


def suffix(column: str = "host") -> Column:
    """The last two labels of a host."""
    return F.substring_index(F.col(column), ".", -2)


def lexical(df: DataFrame, url: str = "url") -> DataFrame:
    """df (with host, path, suffix and top) plus the lexical features that need no training."""
    u = F.coalesce(F.col(url), F.lit(""))
    count = lambda x, c: F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))
    digits = F.length(F.regexp_replace(u, "[^0-9]", ""))
    own = {"length": F.length(u), "host_length": F.length("host"), "depth": count(F.col("path"), "/"), "digit_ratio": F.when(F.length(u) > 0, digits / F.length(u)).otherwise(0.0), "entropy": _entropy(u), "params": count(u, "="), "hyphens": count(F.col("host"), "-"), "labels": count(F.col("host"), "."), "path_length": F.length("path")}
    return df.select("*", *[v.cast("double").alias(k) for k, v in own.items()])


@dataclass(frozen=True)
class Trees:
    """Boosted trees as (feature, threshold, left, right) nodes with leaf values, on top of a base log-odds; rates: smoothed label shares of suffixes."""

    base: float
    trees: tuple
    rate: float

    def logit(self) -> Column:
        def node(t) -> Column:
            return F.lit(float(t)) if isinstance(t, float) else F.when(F.col(t[0]) <= t[1], node(t[2])).otherwise(node(t[3]))

        out = F.lit(self.base)
        for t in self.trees:
            out = out + node(t)
        return out


def _rates(labelled: DataFrame, by: str) -> DataFrame:
    """(value, blocked, labelled) sums per value of a column: partial sums come first, and as a written table Spark may split the rows that join it."""
    sums = labelled.groupBy(F.col(by).alias(f"{by}_key")).agg(F.sum("y").alias(f"{by}_blocked"), F.count("*").alias(f"{by}_labelled"))
    return materialize(sums, f"url_{by}")


def with_rates(rows: DataFrame, rates: dict[str, DataFrame], prior: float, own: bool, strength: float = 20.0) -> DataFrame:
    """rows with suffix_rate and path_rate: the smoothed shares of blocked urls among the labelled ones of their suffix and first path part.

    own: the rows are labelled ones, and each leaves itself out of its rates, so that no rate holds the label it is to tell."""
    y, one = (F.col("y"), 1) if own else (F.lit(0), 0)
    for by, name in (("suffix", "suffix_rate"), ("first", "path_rate")):
        rows = rows.join(rates[by], F.col(by) == F.col(f"{by}_key"), "left")
        blocked, n = F.coalesce(F.col(f"{by}_blocked") - y, F.lit(0)), F.coalesce(F.col(f"{by}_labelled") - one, F.lit(0))
        rows = rows.withColumn(name, (blocked + prior * strength) / (n + strength))
    return rows


def boost(train: DataFrame, n_trees: int = 12, depth: int = 3, bins: int = 16, rate: float = 0.3, ridge: float = 1.0) -> Trees:
    """Gradient-boosted trees with the logistic loss on a materialised train table (FEATURES, y).

    A level of a tree is one aggregation: gradient and curvature sums per node, feature and quantile bin, at most
    2**depth * len(FEATURES) * bins rows, from which the driver takes the splits of largest gain."""
    n, pos = train.agg(F.count("*"), F.sum("y")).first()
    if not n or not pos or pos == n:
        share = min(max((pos or 0) / n, 0.01), 0.99) if n else 0.01
        return Trees(math.log(share / (1 - share)), (), rate)
    base = math.log(pos / (n - pos))
    cuts = train.agg(*[F.array_distinct(F.percentile_approx(f, [(i + 1) / bins for i in range(bins - 1)], 1000)).alias(f) for f in FEATURES]).first().asDict()
    cuts = {f: sorted(c) for f, c in cuts.items()}
    binned = train.select("y", *[sum((F.when(F.col(f) > c, 1).otherwise(0) for c in cuts[f]), F.lit(0)).cast("int").alias(f) for f in FEATURES])
    binned = materialize(binned, "url_bins")
    trees: list = []

    def value(t) -> Column:
        return F.lit(t) if isinstance(t, float) else F.when(F.col(t[0]) <= t[1], value(t[2])).otherwise(value(t[3]))

    for _ in range(n_trees):
        score = F.lit(base)
        for t in trees:
            score = score + value(t)
        p = 1 / (1 + F.exp(-score))
        rows = binned.select(*FEATURES, (p - F.col("y")).alias("g"), (p * (1 - p)).alias("h"))
        splits: dict[int, tuple[str, int]] = {}
        sums: dict[int, tuple[float, float]] = {}
        node = F.lit(1)
        for level in range(depth):
            cells = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f).alias("b")) for i, f in enumerate(FEATURES)]))
            got = rows.select(node.alias("node"), "g", "h", cells.alias("c")).groupBy("node", "c.f", "c.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            for k in sorted({r.node for r in got if 1 << level <= r.node < 2 << level}):
                own = [r for r in got if r.node == k]
                total = [sum(x) for x in zip(*((r.g, r.h) for r in own if r.f == 0), strict=True)]
                sums.setdefault(k, (total[0], total[1]))
                best = (1e-6, None)
                for f in range(len(FEATURES)):
                    gl = hl = 0.0
                    for r in sorted((r for r in own if r.f == f), key=lambda r: r.b)[:-1]:
                        gl, hl = gl + r.g, hl + r.h
                        gr, hr = total[0] - gl, total[1] - hl
                        if hl > 1e-3 and hr > 1e-3 and (gain := gl * gl / (hl + ridge) + gr * gr / (hr + ridge) - total[0] ** 2 / (total[1] + ridge)) > best[0]:
                            best = (gain, (FEATURES[f], r.b, (gl, hl), (gr, hr)))
                if best[1]:
                    f, b, left, right = best[1]
                    splits[k] = (f, b)
                    sums[2 * k], sums[2 * k + 1] = left, right
            for k in [k for k in splits if k >> level == 1]:
                f, b = splits[k]
                node = F.when(node == k, F.when(F.col(f) <= b, 2 * k).otherwise(2 * k + 1)).otherwise(node)
        leaf = lambda k: -rate * sums[k][0] / (sums[k][1] + ridge)
        build = lambda k: (*splits[k], build(2 * k), build(2 * k + 1)) if k in splits else float(leaf(k))
        if 1 not in splits:
            break
        trees.append(build(1))
    real = lambda t: t if isinstance(t, float) else (t[0], cuts[t[0]][t[1]], real(t[2]), real(t[3]))
    return Trees(base, tuple(real(t) for t in trees), rate)


def prepare(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, url, host, path, rule, ruled (the rule's verdict), suffix, first and the lexical features of every url, written and read again."""
    rule, verdict = apply_rules(rules)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url")).withColumn("host", host()).withColumn("path", path())
    rows = rows.withColumn("rule", rule).withColumn("ruled", verdict).withColumn("suffix", suffix())
    rows = rows.withColumn("first", F.substring_index(F.substring(F.col("path"), F.lit(2), F.length("path")), "/", 1))
    return materialize(lexical(rows), "url_rows")


def probabilities(rows: DataFrame, labelled: DataFrame, max_train: int = 50_000) -> DataFrame:
    """prepare()d rows with block_probability, by trees and rates from labelled ones (prepare()d, ruled not null)."""
    labelled = labelled.withColumn("y", F.when(F.col("ruled") == "block", 1).otherwise(0))
    n, pos = labelled.agg(F.count("*"), F.sum("y")).first()
    prior = (pos or 0) / n if n else 0.0
    rates = {by: _rates(labelled, by) for by in ("suffix", "first")}
    share = min(1.0, max_train / max(n, 1))
    chosen = labelled.where(F.pmod(F.xxhash64("host", "path"), F.lit(1_000_000)) < share * 1_000_000)
    model = boost(materialize(with_rates(chosen, rates, prior, True).select("y", *FEATURES), "url_train"))
    return with_rates(rows, rates, prior, False).withColumn("block_probability", 1 / (1 + F.exp(-model.logit())))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, max_train: int = 50_000, threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and block_probability of every url.

    The labelled urls are those that a rule fits; trees are trained on about max_train of them, chosen by hash of host and path, and judge
    the others: block at a probability of `threshold` or more. Suffix statistics are smoothed block rates of host suffixes and of first
    path parts over all labelled urls. Null urls and urls without :// have empty host and path, fit no rule, and are judged on
    their features; without labelled urls the verdict is allow. Repeated rows each have a row; an empty table gives none; other columns are
    not read.
    """
    rows = prepare(pages, rules, id_col, url_col)
    out = probabilities(rows, rows.where("ruled is not null"), max_train)
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("block_probability") >= threshold, "block").otherwise("allow")).alias("verdict"), "block_probability")
