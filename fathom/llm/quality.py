"""Quality classifier: expectation-maximisation over overlapping heuristic labellers, and a hashed linear scorer of its posteriors."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship, whole_text

LABELLERS = ("symbols", "capitals", "repeated_words", "repeated_lines", "bars", "word_length", "sentences", "length")
ABSTAIN, BAD, GOOD = 0, 1, 2
_NOT_LETTER, _NOT_CAPITAL = re.compile(r"[\W\d_]+"), re.compile(r"[^A-ZÀ-ÖØ-Þ]+")
_SYMBOL = re.compile(r"[#$%&*<>=_\\^~|{}@\[\]]|!!|\?\?")


def votes(text: str | None) -> tuple[int, ...]:
    """One vote per labeller, over the whole text: bad, good, or abstain where a heuristic has nothing to say."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return (BAD,) + (ABSTAIN,) * 6 + (BAD,)
    letters = len(_NOT_LETTER.sub("", text))
    upper = len(_NOT_CAPITAL.sub("", text))
    lines = [x for x in text.split("\n") if x.strip()]
    symbols = len(_SYMBOL.findall(text)) / n
    distinct = len(set(words)) / n ** 0.85
    doubled = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    same_lines = 1 - len(set(lines)) / len(lines)
    size = letters / n
    vote = lambda bad, good: BAD if bad else GOOD if good else ABSTAIN
    return (
        vote(symbols > 0.25, symbols < 0.05),
        vote(upper > 0.5 * max(letters, 1), upper < 0.15 * max(letters, 1)),
        vote(doubled > 0.2 or (n > 30 and distinct < 0.35), doubled < 0.05 and n > 30),
        vote(len(lines) > 3 and same_lines > 0.3, len(lines) > 3 and same_lines < 0.1),
        vote(text.count("|") > 0.2 * n, n > 10 and "|" not in text),
        vote(size < 2 or size > 14, 2.5 <= size <= 10),
        vote(n > 30 and not re.search(r"[.!?]", text), bool(re.search(r"[a-zà-ÿ][.!?](?:\s|$)", text))),
        vote(n < 3, n >= 20),
    )


@dataclass(frozen=True)
class LabelModel:
    """accuracy[j][y][v]: chance that labeller j votes v where the true class is y (0 bad, 1 good); prior: share of good texts."""

    accuracy: tuple
    prior: float

    def posterior(self, pattern: tuple[int, ...]) -> float:
        a, b = math.log(self.prior), math.log(1 - self.prior)
        for j, v in enumerate(pattern):
            a, b = a + math.log(self.accuracy[j][1][v]), b + math.log(self.accuracy[j][0][v])
        return 1 / (1 + math.exp(min(700.0, b - a)))


def expectation_maximisation(patterns: dict[tuple[int, ...], int], rounds: int = 50, smooth: float = 1.0) -> LabelModel:
    """Fits a LabelModel to counts of vote patterns; it starts from the majority vote. Patterns are at most 3**labellers, whatever the corpus."""
    k = len(LABELLERS)
    post = {p: (p.count(GOOD) + 0.5) / (p.count(GOOD) + 2 * p.count(BAD) + 1.5) for p in patterns}
    model = LabelModel(tuple(((0.2, 0.6, 0.2), (0.2, 0.2, 0.6)) for _ in range(k)), 0.8)
    for _ in range(rounds):
        acc, good = [[[smooth] * 3, [smooth] * 3] for _ in range(k)], [smooth, smooth]
        for p, n in patterns.items():
            for y, w in ((1, post[p] * n), (0, (1 - post[p]) * n)):
                good[y] += w
                for j, v in enumerate(p):
                    acc[j][y][v] += w
        model = LabelModel(tuple(tuple(tuple(x / sum(row) for x in row) for row in a) for a in acc), good[1] / sum(good))
        post = {p: model.posterior(p) for p in patterns}
    return model


@lru_cache(maxsize=200_000)
def _shape(word: str) -> str:
    return re.sub(r"[a-zà-ÿ]+", "a", re.sub(r"[A-ZÀ-Þ]+", "A", re.sub(r"[0-9]+", "9", word)))[:8]


def hashed(text: str | None, bits: int, vote: tuple[int, ...]) -> dict[int, float]:
    """Features of one whole text: hashed shares of word shapes and of repeated words, and its votes."""
    words = (text or "").split()
    mask = (1 << bits) - 1
    times: Counter = Counter()
    for w, c in Counter(words).items():
        times[_shape(w)] += c
        if c > 1:
            times[" repeated"] += c
    out = {zlib.crc32(k.encode()) & mask: math.sqrt(v / len(words)) for k, v in times.items()}
    for j, v in enumerate(vote):
        out[zlib.crc32(f" v{j}:{v}".encode()) & mask] = 1.0
    return out


def fit_linear(rows: list[dict[int, float]], posteriors: list[float], bits: int, rounds: int = 300, rate: float = 0.05, ridge: float = 1e-4):
    """Logistic regression on soft labels (full-batch Adam); returns (weights by feature, bias)."""
    import numpy as np

    names = sorted({f for r in rows for f in r})
    at = {f: i for i, f in enumerate(names)}
    i = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    j = np.array([at[f] for r in rows for f in r], dtype=np.int64)
    x = np.array([v for r in rows for v in r.values()])
    y = np.array(posteriors)
    w, b = np.zeros(len(names)), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.bincount(i, weights=x * w[j], minlength=len(rows)) + b
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(rows)
        g, gb = np.bincount(j, weights=x * e[i], minlength=len(names)) + ridge * w, e.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-9)
    return {f: float(w[k]) for f, k in at.items()}, float(b)


def score(docs: DataFrame, max_train: int = 5000, bits: int = 18, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1, higher: better), predicted (1 if score >= threshold), weak_posterior of every whole text.

    All texts vote; counts of vote patterns over the whole corpus go to expectation-maximisation. The scorer is fitted on the
    posteriors of at most max_train texts, those with the smallest hashes of id and text; equal rows count once there, so null and repeated ids
    neither crowd the others out nor reach the driver in a mass. Null text counts as empty; repeated rows each have a row; an empty
    table gives no rows; other columns are not read."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))

    def vote(batches):
        import pyarrow as pa

        for batch in batches:
            got = ["".join(map(str, votes(x.as_py()))) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.string())], names=["doc_id", "pattern"])

    voted = materialize(rows.mapInArrow(vote, "doc_id long, pattern string"), "votes")
    patterns = {tuple(map(int, r.pattern)): r.n for r in voted.groupBy("pattern").agg(F.count("*").alias("n")).collect()}
    model = expectation_maximisation(patterns) if patterns else LabelModel(tuple(((1 / 3,) * 3,) * 2 for _ in LABELLERS), 0.5)
    n = sum(patterns.values())
    hashed_rows = rows.withColumn("u", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) / (1 << 40))
    near = hashed_rows.where(F.col("u") < F.lit(1.2 * max_train / n)) if n > max_train else hashed_rows
    chosen = near.groupBy("u").agg(F.first("doc_id").alias("doc_id"), F.min("text").alias("text")).orderBy("u").limit(max_train).select("doc_id", "text")

    def extract(batches):
        import pyarrow as pa

        for batch in batches:
            voted = [votes(x.as_py()) for x in batch.column(1)]
            got = [hashed(x.as_py(), bits, v) for x, v in zip(batch.column(1), voted, strict=True)]
            post = [model.posterior(v) for v in voted]
            yield pa.RecordBatch.from_arrays([pa.array([list(g) for g in got], pa.list_(pa.int32())), pa.array([list(g.values()) for g in got], pa.list_(pa.float64())), pa.array(post, pa.float64())], names=["f", "x", "p"])

    train = chosen.mapInArrow(extract, "f array<int>, x array<double>, p double").collect()
    weights, bias = fit_linear([dict(zip(r.f, r.x, strict=True)) for r in train], [r.p for r in train], bits) if train else ({}, 0.0)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            voted = [votes(t.as_py()) for t in batch.column(1)]
            z = [bias + sum(weights.get(f, 0.0) * x for f, x in hashed(t.as_py(), bits, v).items()) for t, v in zip(batch.column(1), voted, strict=True)]
            post = [model.posterior(v) for v in voted]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([1 / (1 + math.exp(-max(-30.0, min(30.0, s)))) for s in z], pa.float64()), pa.array(post, pa.float64())], names=["doc_id", "score", "weak_posterior"])

    out = rows.mapInArrow(run, "doc_id long, score double, weak_posterior double")
    return out.select("doc_id", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), "weak_posterior")
