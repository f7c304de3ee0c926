"""What the verdict of round 1 asked for: no prefixes, no unsplit ids, held-out accuracy, brute force for trained models."""

import gzip
import io
import math
import random
import re
import time
import tracemalloc
import zipfile
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from fathom.llm import ann, common, media, mixing, orc_tokens, packing, pii, quality, shingles, toxicity, urls
from fathom.llm.queries import tokenizer_path

SMALL = "/root/testdata/sf0.001"


def _entropy(text):
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def test_url_entropy_reads_whole_urls(spark):
    r = random.Random(4)
    long = "http://a.b/" + "p" * 3000
    texts = [long, long + "".join(r.choice("abcdefghij0123456789") for _ in range(3000)), "", "a", "é\U0001d4b3é", None, "http://x/" + "\\E[]^-" * 400]
    rows = spark.createDataFrame(list(enumerate(texts)), "page_id long, url string")
    got = {x.page_id: x for x in urls.prepare(rows).collect()}
    for i, t in enumerate(texts):
        assert math.isclose(got[i].entropy, _entropy(t or ""), abs_tol=1e-9), t and t[:20]
    assert got[1].entropy > got[0].entropy + 1


def test_url_first_path_part_is_whole(spark):
    rows = urls.prepare(spark.createDataFrame([(1, "http://h/" + "q" * 1_200_000 + "/z")], "page_id long, url string"))
    assert rows.select(F.length("first")).first()[0] == 1_200_000


def test_url_trees_on_held_out_rules(spark):
    """Trees that never saw a fifth of the ruled urls tell their rules' verdicts."""
    rows = urls.prepare(spark.read.parquet("/root/testdata/sf0.1/pages.parquet"))
    ruled = rows.where("ruled is not null").withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "page_id"), F.lit(5)))
    got = urls.probabilities(ruled.where("fold = 0"), ruled.where("fold > 0")).select((F.col("ruled") == "block").alias("y"), (F.col("block_probability") >= 0.5).alias("p")).collect()
    assert len(got) > 150
    right = sum(x.y == x.p for x in got) / len(got)
    most = max(Counter(x.y for x in got).values()) / len(got)
    assert right >= 0.9 and right >= most


def test_orc_stripes_indexes_and_bloom_filters(spark, tmp_path):
    """The dealt form: several stripes a file, a row index entry every index_rows rows, and Bloom filters that rule ids out."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = docs.crossJoin(spark.range(60).withColumnRenamed("id", "k")).withColumn("doc_id", F.col("doc_id") * 200 + F.col("k") * 2)
    path = f"file://{tmp_path}/orc"
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        orc_tokens.write_tokens(docs, path, tokenizer_path(), file_bytes=1 << 40, stripe_bytes=256 << 10, index_rows=1000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    files = [x for x in tmp_path.joinpath("orc").iterdir() if x.suffix == ".orc"]
    entries = blooms = stripes = 0
    for x in files:
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(x)), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        assert reader.getRowIndexStride() == 1000 and str(reader.getCompressionKind()) == "ZSTD"
        rows = reader.rows()
        every = spark.sparkContext._gateway.new_array(jvm.boolean, 6)
        for k in range(6):  # the row, its four columns, and the list's items; 1 is doc_id
            every[k] = True
        for k in range(reader.getStripes().size()):
            index = rows.readRowIndex(k, every, every)
            entries += index.getRowGroupIndex()[1].getEntryCount()
            bloom = index.getBloomFilterIndex()[1]
            blooms += bloom.getBloomFilterCount()
            stripes += 1
        rows.close()
        reader.close()
    assert stripes > len(files) and entries >= stripes and blooms == entries


def test_orc_splits_a_mass_of_equal_ids(spark, tmp_path):
    rows = spark.range(4000).select(F.when(F.col("id") < 3900, F.lit(None)).otherwise(F.col("id")).alias("doc_id"), F.lit("same text").alias("text"))
    path = f"file://{tmp_path}/orc"
    got = orc_tokens.encode_to_orc(rows, tokenizer_path(), path).orderBy("start").collect()
    assert [r.start for r in got] == [k * got[0].n_tokens for k in range(4000)]
    assert [r.doc_id for r in got] == [None] * 3900 + list(range(3900, 4000))
    per_file = orc_tokens.read_tokens(spark, path).groupBy("part").count().collect()
    assert len(per_file) >= 6 and max(r["count"] for r in per_file) <= 1500


def test_packing_hands_on_all_that_can_merge(spark):
    """Passing on fan_in bins a group makes no more sequences than passing on all."""
    r = random.Random(6)
    rows = [(i, " ".join(r.choice("abcdefgh") for _ in range(r.choice([3, 40, 300, 420, 600, 900])))) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(24)
    n = [packing.pack(df, tokenizer_path(), keep_open=k, fan_in=4).agg(F.count_distinct("sequence_id")).first()[0] for k in (4, 1 << 20)]
    assert n[0] == n[1]


def test_mixing_shares_out_rows_without_ids(spark, tmp_path):
    """Null and repeated ids, and many equal rows where the target falls, against SQL; every source is within half a document of its target."""
    r = random.Random(7)
    text = lambda n: " ".join(r.choice("abcdef") for _ in range(n))
    same = text(11)
    rows = [(None, same, "a")] * 700 + [(None, text(r.randrange(0, 30)), "a") for _ in range(300)] + [(5, text(7), "b") for _ in range(200)] + [(6, "x y", None)] * 90 + [(i, text(40), "c") for i in range(60)] + [(1, "", "d"), (2, None, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mixture(df).collect()
    df.write.parquet(f"{tmp_path}/d")
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    want = c.sql(f"select doc_id, size, source_size, target, taken from ({mixing.oracle()})").fetchall()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    taken, goal, most = Counter(), {}, Counter()
    for x in got:
        taken[x.source_size] += x.taken
        goal[x.source_size] = x.target
        most[x.source_size] = max(most[x.source_size], x.size)
        assert x.taken <= 3 * x.size
    assert all(abs(taken[k] - goal[k]) <= most[k] / 2 for k in goal)
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and mixed.agg(F.sum(mixing.n_words("text"))).first()[0] == sum(taken.values())


def test_risk_and_gradients_against_sums(spark):
    """The PU risk is what its definition sums up to, and the gradients are its slopes."""
    g = np.random.default_rng(3)
    xp, xu = g.integers(0, 2, (7, 4)).astype(float), g.integers(0, 2, (11, 4)).astype(float)
    share, w, b, prior = np.full(11, 1 / 11), g.standard_normal(4), 0.3, 0.2
    loss = lambda z: math.log(1 + math.exp(-z))
    score = lambda x: float(x @ w + b)
    positive = prior * sum(loss(score(x)) for x in xp) / 7
    negative = sum(loss(-score(x)) for x in xu) / 11 - prior * sum(loss(-score(x)) for x in xp) / 7
    assert np.allclose(toxicity.risk(xp @ w + b, xu @ w + b, share, prior), (positive, negative))
    grads = toxicity.gradients(w, b, xp, xu, share, prior)
    for part in (0, 1):
        for k in range(5):
            step = np.zeros(5)
            step[k] = 1e-6
            up, down = (toxicity.risk(xp @ (w + s * step[:4]) + b + s * step[4], xu @ (w + s * step[:4]) + b + s * step[4], share, prior)[part] for s in (1, -1))
            assert math.isclose((up - down) / 2e-6, grads[part][0][k] if k < 4 else grads[part][1], abs_tol=1e-6)


def test_nn_pu_lowers_the_risk_without_turning_negative():
    g = np.random.default_rng(5)
    texts = lambda n, toxic: [np.unique(np.concatenate([g.integers(20, 400, 30), [3] * toxic, g.integers(8, 12, toxic)])).astype(np.int32) for _ in range(n)]
    p, u = texts(60, 1), texts(80, 1) + texts(720, 0)
    m = toxicity.nn_pu(p, u, 0.1, 8)
    logit = lambda rows: np.array([m.bias + sum(m.weights.get(int(f), 0.0) for f in r) for r in rows])
    share = np.full(len(u), 1 / len(u))
    pos, neg = toxicity.risk(logit(p), logit(u), share, 0.1)
    flat = math.log(0.1 / 0.9)
    before = toxicity.risk(np.full(60, flat), np.full(800, flat), share, 0.1)
    assert pos + max(0, neg) < 0.5 * (before[0] + max(0, before[1])) and neg > -0.02
    assert (logit(u[:80]) > 0).mean() > 0.9 and (logit(u[80:]) > 0).mean() < 0.05


def test_repeated_and_null_ids_stay_bounded(spark):
    """One confirmed id 3000 times, and a mass without ids: what reaches the driver keeps to the bounds, and equal rows count once."""
    rows = [(1, "vile text")] * 3000 + [(None, "no id")] * 3000 + [(None, f"own text {i}") for i in range(300)] + [(i, f"plain words {i}") for i in range(2, 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, 0)], "doc_id long, toxic int")
    seen = {}
    real, toxicity.nn_pu = toxicity.nn_pu, lambda p, u, *a, **k: seen.update(p=len(p), u=len(u)) or toxicity.Model({}, 0.0, 18)
    fit, quality.fit_linear = quality.fit_linear, lambda rows, *a, **k: seen.update(q=len(rows)) or ({}, 0.0)
    try:
        toxicity.train(df, labels, max_positive=10, max_unlabelled=100)
        quality.score(df, max_train=100).count()
    finally:
        toxicity.nn_pu, quality.fit_linear = real, fit
    assert seen["p"] <= 1 and seen["u"] <= 100 and seen["q"] <= 100


def test_expectation_maximisation_against_plain_sums():
    """Every round of EM by plain loops over single texts; and labellers of known accuracies are found again."""
    r = random.Random(8)
    acc = [0.95, 0.9, 0.85, 0.8, 0.75, 0.9, 0.7, 0.8]
    truth = [r.random() < 0.7 for _ in range(4000)]
    texts = [tuple((2 if y == (r.random() < a) else 1) if r.random() < 0.9 else 0 for a in acc) for y in truth]
    counts = Counter(texts)
    post = {p: (p.count(2) + 0.5) / (p.count(2) + 2 * p.count(1) + 1.5) for p in counts}
    for _ in range(50):
        good = [1.0, 1.0]
        table = [[[1.0] * 3, [1.0] * 3] for _ in acc]
        for t in texts:
            for y in (0, 1):
                weight = post[t] if y else 1 - post[t]
                good[y] += weight
                for j, v in enumerate(t):
                    table[j][y][v] += weight
        prior = good[1] / sum(good)
        norm = [[[x / sum(row) for x in row] for row in two] for two in table]
        for p in counts:
            like = [1 - prior, prior]
            for y in (0, 1):
                for j, v in enumerate(p):
                    like[y] *= norm[j][y][v]
            post[p] = like[1] / sum(like)
    model = quality.expectation_maximisation(dict(counts))
    assert math.isclose(model.prior, prior, rel_tol=1e-6)
    assert all(math.isclose(model.posterior(p), post[p], abs_tol=1e-6) for p in counts)
    for j, a in enumerate(acc):
        said = model.accuracy[j][1]
        assert abs(said[2] / (said[1] + said[2]) - a) < 0.04


def test_linear_scorer_against_dense_gradient_descent():
    """The sparse fit ends where the penalised cross-entropy of its soft labels has no slope."""
    g = np.random.default_rng(2)
    rows = [{int(f): float(v) for f, v in zip(g.choice(12, 4, replace=False), g.random(4), strict=True)} for _ in range(200)]
    truth = g.standard_normal(12)
    soft = [1 / (1 + math.exp(-sum(truth[f] * v for f, v in r.items()))) for r in rows]
    weights, bias = quality.fit_linear(rows, soft, 18, rounds=4000, ridge=1e-3)
    x = np.zeros((200, 12))
    for i, r in enumerate(rows):
        for f, v in r.items():
            x[i, f] = v
    w = np.array([weights.get(f, 0.0) for f in range(12)])
    e = (1 / (1 + np.exp(-(x @ w + bias))) - np.array(soft)) / 200
    assert np.abs(x.T @ e + 1e-3 * w).max() < 1e-3 and abs(e.sum()) < 1e-3


def test_carving_is_linear_and_whole():
    """Megabytes of signatures without ends, in seconds; files of several parts are carved whole."""
    began = time.perf_counter()
    for junk in (b"%PDF-1 ", b"PK\x03\x04", b"\x1f\x8b\x08", b"\x1f\x8b\x08\x18", b"\xff\xd8\xff\xda\0\x02", b"OggS\0" + b"\0" * 22, b"BM", b"GIF89a", b"RIFF\0\0\0\0WAVE"):
        list(media.carve(junk * (3_000_000 // len(junk))))
    assert time.perf_counter() - began < 60
    twice = b"%PDF-1.4\nx\n%%EOF\nmore\n%%EOF"
    assert media.sniff(twice)[0] == "application/pdf" and media.Found(0, len(twice), "application/pdf") in media.carve(twice + b"\n%PDF-1.7\ny%%EOF")
    inner, outer = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("a", "b")
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("first", inner.getvalue())
        z.writestr("second", "c")
    found = [x for x in media.carve(b"head" + outer.getvalue() + b"tail") if x.kind == "application/zip"]
    assert media.Found(4, len(outer.getvalue()), "application/zip") in found and len(found) == 2
    named = b"\x1f\x8b\x08\x08\0\0\0\0\0\xff" + b"name\0" + gzip.compress(b"hello" * 1000)[10:]
    assert media.Found(2, len(named), "application/gzip") in media.carve(b"xx" + named + b"yy")
    bomb = gzip.compress(b"\0" * 300_000_000)
    tracemalloc.start()
    assert media.sniff(bomb)[0] == "application/gzip"
    assert tracemalloc.get_traced_memory()[1] < 20_000_000
    tracemalloc.stop()


def test_redact_is_linear_in_spans(spark):
    """Tens of thousands of spans in one text, with characters beyond the basic plane, against plain Python."""
    parts = [f"\U0001d4b3{i % 7} a{i}@b.co, " + "w" * (i % 50) for i in range(20_000)]
    df = spark.createDataFrame([(1, "".join(parts)), (2, None), (3, "")], "doc_id long, text string")
    began = time.perf_counter()
    got = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert time.perf_counter() - began < 120
    assert got == {1: re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[EMAIL]", "".join(parts)), 2: None, 3: ""}


def test_context_words_are_whole(spark):
    """The word before a number counts whole, however long, and so does what lies between."""
    cards = ["4111111111111111", "5500005555555559", "4012888888881881", "6011111111111117", "5105105105105100", "4222222222222220"]
    word = "w" * 300
    rows = [(i, f"x{i} {word}{' ' * 90}{c} y{i}") for i, c in enumerate(cards)]
    rows += [(100 + i, f"n{i} order{i} 41111111111{i + 10:05d} m{i}") for i in range(20)]  # the shape alone says nothing
    rows += [(20, f"z {word}{' ' * 90}4111111111111112 u"), (21, f"z q{word}{' ' * 90}4111111111111113 u"), (22, "." * 200_000 + " 12345 " + "9." * 100_000)]
    got = {r.doc_id: r.spans for r in pii.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[20] == f"card:{2 + 300 + 90}:{2 + 300 + 90 + 16}" and got[21] == ""
    m = pii.mentions(spark.createDataFrame([(1, f"aa {word} 4111111111111111 {word[:250]}, b")], "__row long, text string").select("__row", pii.hits(F.col("text")).alias("hits"))).where("kind = 2").first()
    assert (m.w1, m.w2, m.w3) == (word, f"aa {word}", word[:250])


def test_components_against_union_find(spark):
    """Chains, hubs and cycles over several partitions."""
    r = random.Random(9)
    links = [(i, i + 1) for i in range(3000, 3400)] + [(1, 5000 + i) for i in range(2000)] + [(r.randrange(10_000, 11_000), r.randrange(10_000, 11_000)) for _ in range(700)]
    r.shuffle(links)
    low = {}

    def root(x):
        low.setdefault(x, x)
        while low[x] != x:
            x = low[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((root(a), root(b)))
            low[y] = x
    df = spark.createDataFrame(links, "a long, b long").repartition(7)
    want = {x: root(x) for x in low}
    for over in (0, 1 << 40):
        assert {x.node: x.root for x in common.components(df, split_over=over).collect()} == want


def test_similar_groups_with_split_tokens(spark):
    """Tokens of more rows than `hot` are compared block by block; no pair is lost."""
    from .test_advice_r01 import _crowd, _lowest

    rows = list(enumerate(_crowd(), 1))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {x.doc_id: x.component_id for x in shingles.similar_groups(df, reach=1, sample=50, hot=5).collect()} == _lowest(rows)


def _nearest(rows, k=20, every=20):
    out = {}
    vectors = {}
    for i, v in rows:
        if i % every == 0:
            vectors[i] = min(vectors.get(i, v), v)
    for q, v in vectors.items():
        got = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q), key=lambda x: (round(x[0], 9), x[1]))
        out[q] = [i for _, i in got[:k]]
    return out


def test_neighbours_with_repeated_ids(spark):
    """Rows of a query's own id never take the places of others, however many there are, of one vector or of many."""
    g = np.random.default_rng(4)
    spread = [tuple(float(x) for x in v) for v in g.integers(-3, 4, (120, 6)) if v.any()]
    rows = [(20, (9.0,) * 6)] * 30 + [(20, (9.0, 9.0, 9.0, 9.0, 9.0, float(x))) for x in range(40)] + [(1000 + i, (9.0,) * 6) for i in range(25)] + [(40, (1.0, 0, 0, 0, 0, 0)), (40, (0.0, 1, 0, 0, 0, 0))] + [(7, (8.0,) * 6)] * 50 + list(enumerate(spread, 2001))
    rows = [(i, tuple(map(float, v))) for i, v in rows]
    df = spark.createDataFrame([(i, list(v)) for i, v in rows], "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in ann.nearest(df, block_rows=90, query_rows=2, confidence=0.999999).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == _nearest(rows)


def test_neighbours_recall_on_whole_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    t = rows.where("vec_id is not null and embedding is not null").toArrow()
    ids, x = t.column("vec_id").to_numpy(), np.array(t.column("embedding").to_pylist(), dtype=np.float64)
    hits = total = 0
    got = {}
    for r in ann.nearest(rows).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[ids == ids[q]] = -np.inf
        want = ids[np.lexsort((ids, -s))[:20]]
        hits, total = hits + len(got[ids[q]] & set(want.tolist())), total + 20
    assert hits / total >= 0.9
