"""What the findings of FINDINGS_r02.md asked for."""

import gc
import re
import tracemalloc
from types import SimpleNamespace

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from fathom.llm import shingles, simhash, tokens, toxicity
from fathom.llm.queries import tokenizer_path

from .test_advice_r01 import COLUMNS, SMALL, _crowd, _lowest


def _fingerprint(text, words=5):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + words]), 42) for i in range(max(1, len(w) - words + 1))] if w else []
    x = sum(1 << b for b in range(64) if 2 * sum(y >> b & 1 for y in h) > len(h))
    return x - (1 << 64) if x >> 63 else x


def _roots(nodes, links):
    low = {x: x for x in nodes}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        low[y] = x
    return {x: root(x) for x in low}


def test_near_duplicates_go_through_simhash(spark, monkeypatch):
    """the pipeline's stage takes the five-word fingerprints of all its rows through the operator's grid."""
    import corpus_pipeline as p

    texts = [*_crowd(), None, "a b c d e " * 40, "a b c d e " * 70]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts, 1)], COLUMNS).repartition(3)
    taken, grid = [], simhash.near_links

    def near_links(fps, *args, **kw):
        taken.append(sorted(r.fp for r in fps.collect()))
        return grid(fps, *args, **kw)

    monkeypatch.setattr(simhash, "near_links", near_links)
    got = {r.doc_id for r in p.drop_near_duplicates(spark, df, SMALL).collect()}
    assert taken == [sorted({_fingerprint(t) for t in texts})]
    assert got == set(_lowest(list(enumerate(texts, 1))).values())


def test_fingerprint_candidates_span(spark):
    """Candidates join the nodes that brute force joins within three bits, nodes of one fingerprint and a node of two included, and no others."""
    pairs = [(k, fp) for k, fp in enumerate([0, 1, 7, 15, 127, -1, -2, -16, 1 << 40, (1 << 40) + 3, 0, 15, 1 << 62], 10)] + [(10, 0), (22, -8)]
    got = [(r.a, r.b) for r in shingles._by_fingerprint(spark.createDataFrame(pairs, "node long, fp long").repartition(3), 3).collect()]
    near = lambda x, y: ((x ^ y) & (1 << 64) - 1).bit_count() <= 3
    want = [(a, b) for k, (a, x) in enumerate(pairs) for b, y in pairs[k + 1 :] if near(x, y)]
    nodes = {a for a, _ in pairs}
    assert len(got) == len(set(got)) and all(a < b for a, b in got)
    assert _roots(nodes, got) == _roots(nodes, want)


def test_thinning_needs_little_memory():
    """dropping kept pieces makes no object for each one that stays (311 bytes a piece before, 199 after); ids stay the same."""
    enc = tokens.IdEncoder(tokenizer_path())
    text = " ".join(f"w{i:x}q" for i in range(100_000))
    first = enc.encode(text)
    enc.encode(text)
    tracemalloc.start()
    enc._thin()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(enc.known) >= 100_000 and most < 255 * len(enc.known)
    assert enc.encode(text) == first


def test_workers_make_room_for_other_operators(spark, monkeypatch):
    """F1 of the second list: the stages before mixing drop the encoder that packing's tasks have kept in a worker (before, it stayed, with collections off)."""
    df = spark.createDataFrame([(1, "a b c d e f", "en", "s", 1)], COLUMNS)
    tasks, in_arrow, in_pandas = [], type(df).mapInArrow, toxicity.F.pandas_udf
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, *a, **kw: tasks.append(f) or in_arrow(self, f, *a, **kw))
    monkeypatch.setattr(toxicity.F, "pandas_udf", lambda kind: lambda f: tasks.append(f) or in_pandas(kind)(f))
    model = SimpleNamespace(logit=len)
    toxicity.score(df, model)
    toxicity.keep_clean(df, model)
    shingles.similar_groups(df.withColumn("row", F.col("doc_id")), row_col="row")
    score, toxic = tasks[:2]
    sign = next(f for f in tasks if f.__name__ == "sign")
    docs = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["a b"]})
    rows = pa.RecordBatch.from_pydict({"doc_id": [1], "row": [1], "text": ["a b"]})
    try:
        for task in (lambda: list(score([docs])), lambda: toxic(pd.Series(["a b"])), lambda: list(sign([rows]))):
            assert tokens.encoder(tokenizer_path(), 2).encode("a b") and tokens._ENCODERS
            task()
            assert not tokens._ENCODERS and gc.isenabled()
    finally:
        gc.enable()
