"""Toxicity by non-negative positive-unlabelled learning: a linear classifier over hashed words, trained with numpy."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, make_room, ship, whole_text

_WORD = re.compile(r"[^\W\d_]+")
_CACHES: dict = {}


def of_word(word: str, bits: int) -> list[int]:
    """Bucket numbers of one word: the word and, as inflected forms share stems, its beginnings of 5 and 6 letters."""
    mask = (1 << bits) - 1
    return [zlib.crc32(x.encode()) & mask for x in (word, *(word[:n] + "*" for n in (5, 6) if len(word) >= n))]


def features(text: str | None, bits: int) -> set[int]:
    """4 * bucket + level, for level 1, 2, 3 as one, two, three or more distinct words of the text fall into a bucket."""
    times = Counter(f for w in set(_WORD.findall((text or "").lower())) for f in of_word(w, bits))
    return {4 * f + level for f, n in times.items() for level in range(1, min(n, 3) + 1)}


@dataclass(frozen=True)
class Model:
    """weights: feature number -> weight; bits: words fall into 2**bits buckets."""

    weights: dict[int, float]
    bias: float
    bits: int

    def logit(self, text: str | None) -> float:
        """Sum of the weights of the features of one whole text. Which buckets matter for a word is kept per worker, up to a bound."""
        known = _CACHES.setdefault((self.bias, self.bits, len(self.weights)), {})
        weights, times = self.weights, {}
        for w in set(_WORD.findall((text or "").lower())):
            if (got := known.get(w)) is None:
                got = [f for f in of_word(w, self.bits) if any(4 * f + level in weights for level in (1, 2, 3))]
                if len(known) >= 300_000:
                    known.clear()
                known[w] = got
            for f in got:
                times[f] = times.get(f, 0) + 1
        return self.bias + sum(weights.get(4 * f + level, 0.0) for f, n in sorted(times.items()) for level in range(1, min(n, 3) + 1))


def risk(gp, gu, share, prior: float) -> tuple[float, float]:
    """(positive, negative) part of the PU risk with the logistic loss: gp are the scores of confirmed texts, gu those of unlabelled ones with their shares.

    positive = pi * E_P[l(g)], negative = E_U[l(-g)] - pi * E_P[l(-g)]; the non-negative risk is positive + max(0, negative)."""
    import numpy as np

    return prior * float(np.mean(np.logaddexp(0, -gp))), float(share @ np.logaddexp(0, gu)) - prior * float(np.mean(np.logaddexp(0, gp)))


def gradients(w, b, xp, xu, share, prior: float) -> tuple:
    """Gradients of the two parts of the risk by (weights, bias): (positive, negative)."""
    import numpy as np

    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    gp, gu = sig(xp @ w + b), sig(xu @ w + b)
    positive = (-prior * xp.T @ (1 - gp) / len(xp), -prior * float((1 - gp).mean()))
    return positive, (xu.T @ (share * gu) - prior * xp.T @ gp / len(xp), float(share @ gu - prior * gp.mean()))


def nn_pu(positive: list, unlabelled: list, prior: float, bits: int, top: int = 256, min_docs: int = 2, rounds: int = 600, rate: float = 0.1, ridge: float = 4.0, most_ridge: float = 0.02) -> Model:
    """Minimises the non-negative PU risk  pi * E_P[l(g)] + max(0, E_U[l(-g)] - pi * E_P[l(-g)])  with the logistic loss.

    positive, unlabelled: arrays of feature numbers, one per text. Only the `top` features whose rate among positives most
    exceeds the rate that the class prior lets negatives have take part; with few confirmed texts, the others would
    only add noise. The penalty on the weights is ridge / (number of positives), at most most_ridge: it matters less the more there are. A feature that negatives lack is prior times as frequent among unlabelled texts as among positives, and others more so: the median of that
    ratio over the 64 strongest features takes the prior's place where it is smaller. Where the negative risk turns below zero, the step goes back along its gradient, as the estimator asks.
    """
    import numpy as np

    size = 4 << bits
    if not positive or not unlabelled:
        return Model({}, float(np.log(max(prior, 1e-4) / (1 - min(prior, 0.99)))) if prior else -4.0, bits)
    n_p, n_u = len(positive), len(unlabelled)
    df_p = np.bincount(np.concatenate(positive).astype(np.int64), minlength=size)
    df_u = np.bincount(np.concatenate(unlabelled).astype(np.int64), minlength=size)
    rate_p = (df_p + 0.1) / (n_p + 0.2)
    rate_n = np.clip((df_u + 0.1) / (n_u + 0.2) - prior * rate_p, 0.3 / n_u, None) / (1 - prior)
    gain = df_p / n_p * np.log(rate_p / rate_n)  # expected evidence in a positive text
    gain[(df_p < min_docs) | (rate_p < 2 * rate_n)] = 0
    chosen = np.argsort(-gain, kind="stable")[:top]
    chosen = np.sort(chosen[gain[chosen] > 0])
    if not len(chosen):
        return Model({}, float(np.log(max(prior, 1e-4) / (1 - prior))), bits)

    best = np.argsort(-gain, kind="stable")[:64]
    best = best[gain[best] > 0]
    prior = float(min(prior, max(1e-3, np.median(df_u[best] / n_u / (df_p[best] / n_p)))))

    def dense(rows):
        """Rows as bits of the chosen features, packed; equal rows once, with their shares."""
        x = np.zeros((len(rows), len(chosen)), bool)
        for i, r in enumerate(rows):
            at = np.searchsorted(chosen, r := np.asarray(r))
            x[i, at[(at < len(chosen)) & (chosen[np.minimum(at, len(chosen) - 1)] == r)]] = True
        x = np.packbits(x, axis=1)
        _, first, times = np.unique(x.view(f"V{x.shape[1]}").ravel(), return_index=True, return_counts=True)
        return np.unpackbits(x[first], axis=1, count=len(chosen)).astype(np.float64), times / len(rows)

    xp = np.zeros((n_p, len(chosen)))
    for i, r in enumerate(positive):
        xp[i, np.isin(chosen, r)] = 1
    xu, share = dense(unlabelled)
    w, b, penalty = np.zeros(len(chosen)), float(np.log(prior / (1 - prior))), min(most_ridge, ridge / n_p)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        (gp, gp_b), (gn, gn_b) = gradients(w, b, xp, xu, share, prior)
        negative = risk(xp @ w + b, xu @ w + b, share, prior)[1]
        g, gb = (gp + gn, gp_b + gn_b) if negative >= 0 else (-gn, -gn_b)
        g = g + penalty * prior * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        fix1, fix2 = 1 - 0.9**t, 1 - 0.999**t
        w -= rate * (m / fix1) / (np.sqrt(v / fix2) + 1e-9)
        b -= rate * (mb / fix1) / (np.sqrt(vb / fix2) + 1e-9)
    return Model({int(f): float(x) for f, x in zip(chosen, w, strict=True)}, float(b), bits)


def held_out(column: str = "doc_id"):
    """True where crc32 of the id as text leaves 2 modulo 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _some(rows: DataFrame, n: int, most: int) -> DataFrame:
    """At most `most` of about n rows (u, text): those with the smallest u, each u once. u is a hash, so of equal rows one takes part."""
    near = rows.where(F.col("u") < F.lit(min(1.0, 1.2 * most / max(1, n)))) if n > most else rows
    return near.groupBy("u").agg(F.min("text").alias("text")).orderBy("u").limit(most)


def train(docs: DataFrame, labels: DataFrame, max_positive: int = 4000, max_unlabelled: int = 12000, bits: int = 18) -> Model:
    """Fits nn_pu: P are the documents with a label toxic = 1, U are documents of all kinds, labelled or not; neither holds one that is held out.

    The class prior is the share of toxic = 1 among the labels that are not held out. At most max_positive and max_unlabelled texts are
    used, those with the smallest hashes of id and text: that bounds what the driver receives, also where ids are null or repeated. Equal rows
    count once. Labels without a document, null ids and null labels are left out; of repeated labels for an id the larger counts. Other
    columns of docs and labels are not read, whatever their names. Without confirmed texts, as from empty tables, the score is the prior.
    """
    ship(docs.sparkSession)
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").alias("toxic"))
    n, n_p = known.agg(F.count("*"), F.count_if(F.col("toxic") == 1)).first()
    prior = min(0.9, max(n_p / n, 1e-3)) if n else 1e-3
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).where(~held_out())
    rows = rows.withColumn("u", F.pmod(F.xxhash64(F.lit("pu"), "doc_id", "text"), F.lit(1 << 40)) / (1 << 40))
    # by id first: the list that is broadcast is bounded, whatever the number of labels
    ids = known.where("toxic = 1").orderBy(F.xxhash64(F.lit("pu"), "id"), "id").limit(max_positive).select("id")
    confirmed = rows.join(F.broadcast(ids), F.col("doc_id") == F.col("id"), "left_semi").groupBy("u").agg(F.min("text").alias("text")).orderBy("u").limit(max_positive)
    every = _some(rows.select("u", "text"), rows.count(), max_unlabelled)

    def run(batches):
        import pyarrow as pa

        make_room()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sorted(features(x.as_py(), bits)) for x in batch.column(0)], pa.list_(pa.int32()))], names=["f"])

    def sets(of: DataFrame) -> list:
        f = of.select("text").mapInArrow(run, "f array<int>").toArrow().column("f")
        return [np.asarray(x.values, dtype=np.int32) for part in f.chunks for x in part]

    import numpy as np

    model = nn_pu(sets(confirmed), sets(every), prior, bits)
    give_back()
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.3, keep_text: bool = False) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold) of every whole text.

    Null text counts as empty; a null id is not held out; repeated rows each have a row; an empty table gives none; other columns are not read."""
    ship(docs.sparkSession)

    def run(batches):
        import math

        import pyarrow as pa

        make_room()
        for batch in batches:
            got = [1 / (1 + math.exp(-max(-30.0, min(30.0, model.logit(x.as_py()))))) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """docs without the rows that the model rejects; all columns stay as they are."""
    ship(docs.sparkSession)

    @F.pandas_udf("boolean")
    def toxic(texts):
        import math

        make_room()
        return texts.map(lambda x: 1 / (1 + math.exp(-max(-30.0, min(30.0, model.logit(x))))) >= threshold)

    return docs.where(~toxic(whole_text()))
