"""The training-data operators against brute force on small inputs, and on awkward tables."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fathom.llm import ann, common, media, mixing, orc_tokens, packing, pii, quality, simhash, toxicity, urls
from fathom.llm.queries import tokenizer_path
from fathom.llm.tokens import IdEncoder

from .test_advice_r01 import _lowest

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, key string, fp long, hits string, h string, bin_id int, value string"
EXTRA = (1, "x", 2, "y", "z", 3, "v")
LONG = "word " * 30_000 + "a@b.co"
ROWS = [
    (1, "alpha beta gamma delta", "en", "s1", 22, *EXTRA),
    (1, "alpha beta gamma delta", "en", "s1", 22, *EXTRA),
    (2, "Alpha BETA gamma delta", None, "s2", None, *EXTRA),
    (3, "", "en", None, 0, *EXTRA),
    (4, None, None, None, None, *[None] * 7),
    (None, "call +1 (017) 555-7713 or a@b.co, 10.0.0.1", "de", "s1", 5, *EXTRA),
    (5, LONG, "fr", "s3", len(LONG), *EXTRA),
    (6, " \n\t ", "en", "s2", 4, *EXTRA),
    (7, "é 日本 \U0001d4b3 x@y.zz 4111 1111 1111 1111", "en", "", 9, *EXTRA),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def coder():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    return lambda x: np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], dtype="<u4").tobytes()


def _texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("text", ["", " ", "a", "a  b", " a b ", "a\n b\n\n c", "don't we'll", "<|endoftext|> x", "q 日本語 テスト", "a\tb c", "x.y, z! w", "\u3000 a", "a" * 500 + " b"])
def test_encoder(coder, text):
    e = IdEncoder(tokenizer_path(), keep=3)
    assert e.encode(text) == coder(text) == e.encode(text)
    assert list(e.encode_many([text, None, "the same, the same"], 1)) == [coder(text), coder(""), coder("the same, the same")]


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_packing(request, coder, which):
    df = request.getfixturevalue(which)
    got = packing.pack(df, tokenizer_path(), keep_open=8, fan_in=2).collect()
    ids = {d: coder(t) for d, t in _texts(df)}
    total = sum(len(coder(t)) // 4 for _, t in _texts(df))
    assert sum(r.length for r in got) == total
    for r in got:
        assert zlib.crc32(ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= math.ceil(total / 1024) * 1.03 + 2
    assert packing.pack(df.limit(0), tokenizer_path()).count() == 0


def test_best_fit_and_cut():
    assert packing.best_fit([7, 5, 3, 3, 2], 10) == [0, 1, 0, 1, 1]
    assert list(packing.cut(2500, 1024)) == [(0, 452), (452, 1024), (1476, 1024)]
    assert list(packing.cut(1024, 1024)) == [(0, 1024)]


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_orc(spark, request, coder, which, tmp_path):
    df = request.getfixturevalue(which)
    path = f"file://{tmp_path}/orc"
    got = orc_tokens.encode_to_orc(df, tokenizer_path(), path).collect()
    want = sorted(((d, coder(t)) for d, t in _texts(df)), key=lambda x: (x[0] is not None, x[0] or 0))
    got = sorted(got, key=lambda r: r.start)
    assert [(r.doc_id, r.n_tokens, r.ids_crc32) for r in got] == [(d, len(b) // 4, zlib.crc32(b)) for d, b in want]
    assert [r.start for r in got] == list(np.cumsum([0] + [len(b) // 4 for _, b in want])[:-1])
    assert orc_tokens.read_tokens(spark, path).where("doc_id = 3").count() == sum(d == 3 for d, _ in want)
    assert orc_tokens.encode_to_orc(df.limit(0), tokenizer_path()).count() == 0


def _fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(fps):
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fps = sorted(parent)
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    return root


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_simhash(request, which):
    df = request.getfixturevalue(which)
    got = simhash.near_duplicates(df).collect()
    rows = [(d, _fingerprint(t)) for d, t in _texts(df)]
    root = _components([f for _, f in rows])
    low = {}
    for d, f in rows:
        if d is not None:
            low[root(f)] = min(d, low.get(root(f), d))
    assert sorted(((r.doc_id or -1, r.fingerprint, r.component_id or -1) for r in got)) == sorted((d or -1, f"{f:016x}", low.get(root(f)) or -1) for d, f in rows)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("hot,small", [(8192, 48), (20, 4)])
def test_near_links_complete(spark, hot, small):
    """Dense clusters, with cells split into blocks and without: the links connect what brute force connects."""
    r = random.Random(3)
    fps = set()
    for _ in range(6):
        c = r.getrandbits(64)
        fps |= {c ^ sum(1 << b for b in r.sample(range(64), r.randrange(0, 4))) for _ in range(60)}
    fps |= {r.getrandbits(64) for _ in range(200)} | {0, 1, (1 << 64) - 1}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    links = simhash.near_links(df, hot=hot, small=small).collect()
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 3 for a, b in links)
    got = {r.node: r.root for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = _components(fps)
    groups = {}
    for f in fps:
        groups.setdefault(root(f), set()).add(signed(f))
    for g in groups.values():
        assert {got.get(f, f) for f in g} == {min(g)}


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(200, 100), (100, 200), (7, 7), (None, 3)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 200: 100}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_mixing(spark, request, which, tmp_path):
    df = request.getfixturevalue(which).select("doc_id", "text", "source")
    got = mixing.mixture(df).collect()
    df.write.parquet(f"{tmp_path}/d")
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    want = c.sql(f"select doc_id, size, source_size, target, taken from ({mixing.oracle()})").fetchall()
    key = lambda x: [str(v) for v in x]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert all(r.taken <= 3 * r.size for r in got)
    assert mixing.mixture(df.limit(0)).count() == 0


def test_mix_rows(odd):
    taken = mixing.mixture(odd).agg(F.sum("taken")).first()[0]
    rows = mixing.mix(odd)
    assert rows.columns == odd.columns
    assert rows.agg(F.sum(mixing.n_words("text"))).first()[0] == taken


def test_water_filling(spark):
    """Against the iterative rule: clamp what is above its cap, share the excess by weight, until none is above."""
    r = random.Random(1)
    sizes = {f"={k:02d}": r.choice([0, 1, 5, 50, 3000]) for k in range(20)} | {"": 70}
    got = {x.key: x.target for x in mixing.targets(spark.createDataFrame(list(sizes.items()), "key string, size long")).collect()}
    order = sorted(sizes, key=lambda k: (k == "", k))
    w = {k: i % 3 + 1 for i, k in enumerate(order)}
    fixed = {}
    while True:
        free = [k for k in order if k not in fixed]
        level = (sum(sizes.values()) - sum(fixed.values())) / sum(w[k] for k in free)
        over = [k for k in free if level * w[k] > 3 * sizes[k]]
        if not over:
            break
        fixed |= {k: 3.0 * sizes[k] for k in over}
    assert got == pytest.approx(fixed | {k: level * w[k] for k in free})


def test_toxicity(spark, odd):
    r = random.Random(2)
    words = [f"w{i}" for i in "abcdefghijklmnopqrstuvwxyz"]
    rows = [(i, " ".join(r.choices([w + x for w in words for x in ("an", "or", "el")], k=40)) + (" you vileling, vilelous and grotty" if i % 9 == 0 else "")) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(900)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(df, labels)
    got = toxicity.score(df, model).collect()
    held = [x for x in got if x.held_out]
    assert {x.doc_id for x in held} == {i for i in range(900) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(x.predicted == (x.doc_id % 9 == 0) for x in held) / len(held) > 0.97
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in got)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.train(df, flipped) == model
    assert toxicity.keep_clean(df, model).count() == sum(x.predicted == 0 for x in got)
    assert toxicity.score(odd, model).count() == len(ROWS)
    assert toxicity.keep_clean(odd, model).columns == odd.columns
    none = toxicity.train(odd, labels.limit(0))
    assert toxicity.score(odd.limit(0), none).count() == 0


def test_quality(odd, docs):
    m = quality.expectation_maximisation({(2,) * 8: 80, (1,) * 8: 15, (2, 2, 1, 2, 2, 2, 2, 2): 5})
    assert m.posterior((2,) * 8) > 0.9 > 0.1 > m.posterior((1,) * 8)
    got = quality.score(docs).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert sum((r.score >= 0.5) == (r.weak_posterior >= 0.5) for r in got) / len(got) > 0.9
    assert quality.score(odd).count() == len(ROWS)
    assert quality.score(odd.limit(0)).count() == 0


def test_neighbours(spark):
    g = np.random.default_rng(1)
    x = g.standard_normal((400, 8)).astype(np.float32)
    x[:40] = x[0]
    rows = [(i, [float(v) for v in x[i]]) for i in range(400)] + [(400, None), (420, [0.0] * 8), (440, [float("nan")] * 8), (460, [None] + [1.0] * 7), (None, [1.0] * 8), (20, [float(v) for v in x[20]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = {}
    for r in ann.nearest(df, block_rows=100, query_rows=7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score, r["rank"]))
    assert sorted(got) == list(range(0, 400, 20))
    x = x.astype(np.float64)
    hits = 0
    for q, found in got.items():
        s = (x * x[q]).sum(axis=1)
        want = [i for i in np.lexsort((np.arange(400), -s)) if i != q][:20]
        assert [r for _, _, r in found] == list(range(1, 21))
        assert all(abs(s[i] - v) < 1e-12 for i, v, _ in found)
        hits += len({i for i, _, _ in found} & set(want))
    assert hits / (20 * len(got)) >= 0.9
    tied = [i for i, _, _ in got[0] if i < 40]  # equal vectors: ties go to smaller ids
    assert len(tied) > 3 and tied == list(range(1, len(tied) + 1))
    assert ann.nearest(df.limit(0)).count() == 0
    assert ann.chi2_quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3)


def _luhn(d):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0


def _base(text):
    out = []
    for kind, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and any(int(x) > 255 for x in m[0].split("."))) or (kind == "card" and not (13 <= len(d) <= 19 and _luhn(d))) or (kind == "phone" and not 9 <= len(d) <= 15):
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


TRICKY = ["a@b.c_d@e.f x@y..z x@y.z. a@b-.c-d.e..f q@w.e@r.t.y", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 0000001.2.3.4", "4111 1111 1111 1111 4111-1111--1111-1111 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1x", "+49(0)1234567890- ++123456789 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "\U0001d4b3 a@b.co \U0001d4b3 1.1.1.1 ÿ +123456789012", "\uffff4111\uffff111111111111 1\uffff2", "9" * 2000, "1 " * 1500, "a@b" + ".c" * 1500, "a@b.co +4912345678901 10.0.0.1 4111111111111111 " * 40]


def test_pii(spark, odd, docs):
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(TRICKY)], "doc_id long, text string")
    for df in (more, odd.where("doc_id is null or doc_id <> 1"), docs):
        texts = dict(_texts(df))
        for r in pii.digest(df).collect():
            want = _base(texts[r.doc_id])
            assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k + ":") for x in want) for k in pii.KINDS]
            assert set(want) <= set(r.spans.split(",") if r.spans else [])
    assert pii.digest(odd).count() == len(ROWS) and pii.digest(odd.limit(0)).count() == 0


def test_pii_discovers(spark):
    """Numbers that fail the checksum but stand where valid ones do are found; others are not."""
    good = [(i, f"pay with card 4111111111111111 today {i}") for i in range(12)]
    good = [(i, t.replace("4111111111111111", n)) for (i, t), n in zip(good, ["4111111111111111", "5500005555555559", "4012888888881881", "378282246310005", "6011111111111117", "5105105105105100"] * 2, strict=True)]
    rows = [*good, (50, "pay with card 4111111111111112 today 1"), (51, "order number 4111111111x1112 came")]
    got = {r.doc_id: r.spans for r in pii.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[50] == "card:14:30" and got[51] == ""
    clean = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert clean[50] == "pay with card [CARD] today 1" and clean[51] == rows[-1][1]


def test_redact(odd):
    got = pii.redact(odd)
    assert got.columns == odd.columns
    text = {r.doc_id: r.text for r in got.collect()}
    assert text[None] == "call [PHONE] or [EMAIL], [IP]" and text[4] is None and text[3] == ""
    assert text[5].endswith("word [EMAIL]")


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_media(request, which):
    df = request.getfixturevalue(which)
    got = media.read_back(media.store_texts(df)).collect()
    want = []
    for d, t in _texts(df):
        raw = (t or "").encode()
        p = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        want.append((d or -1, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    assert sorted((r.doc_id or -1, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted(want)
    assert {r.media_type for r in got} == {"audio/wav"}
    assert media.read_back(media.store_texts(df.limit(0))).count() == 0


def test_carving(spark):
    import gzip
    import io
    import struct
    import zipfile

    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"\0" * 13) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0" * 6 + b"\x2c" + b"\0" * 9 + b"\x02\x02\x44\x01\0" + b"\x3b"
    wav, gz, pdf = media.wav(b"abc"), gzip.compress(b"hello"), b"%PDF-1.4\nx\n%%EOF"
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a", "b")
    bmp = b"BM" + struct.pack("<IIII", 58, 0, 54, 40) + b"\0" * 40
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xda\0\x02zz\xff\xd9"
    for data, kind in ((png, "image/png"), (gif, "image/gif"), (wav, "audio/wav"), (gz, "application/gzip"), (pdf, "application/pdf"), (z.getvalue(), "application/zip"), (bmp, "image/bmp"), (jpeg, "image/jpeg")):
        assert media.sniff(data, "text/plain") == (kind, []), kind
        found = list(media.carve(b"....junk" + data))
        assert (8, len(data), kind) in found, (kind, found)
        assert kind not in [x.kind for x in media.carve(data[:-3])] or kind in ("image/bmp",)
    assert media.wav_payload(wav) == b"abc" and len(wav) % 2 == 0
    df = spark.createDataFrame([(1, bytearray(b"x" + png), "image/gif"), (2, None, None), (3, bytearray(b""), "image/png")], "doc_id long, media binary, declared string")
    got = {r.id: r for r in media.sniff_column(df, declared="declared").collect()}
    assert got[1].media_type == "application/octet-stream" and bytes(got[1].embedded[0].content) == png
    assert got[2].media_type == got[3].media_type == "application/octet-stream"


def _url(u):
    if u is None or "://" not in u:
        return "", "", None
    rest = u.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for verdict, rule in urls.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best


def test_urls(spark):
    odd = [None, "", "nothing", "http://", "HTTP://A.Example.NET/EN/", "http://x.example.net/en/a?b#c", "http://example.com/de/", "http://notexample.com/de/x", "http://org/fr/", "http://a.org?x=/fr/", "x://net", "x://net/", "a://b://c/d", "http://É.net/ü", "http://a.net/" + "p/" * 5000]
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url").union(spark.createDataFrame([(10_000 + i, u) for i, u in enumerate(odd)], "page_id long, url string")).withColumn("host", F.lit(1)).withColumn("suffix", F.lit(2))
    got = urls.judge(pages)
    source = {r.page_id: r.url for r in pages.collect()}
    for r in got.collect():
        host, path, best = _url(source[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, best and best[1]), source[r.page_id]
        assert r.verdict == (best[0] if best else ("block" if r.block_probability >= 0.5 else "allow"))
    assert urls.judge(pages.limit(0)).count() == 0


def test_boosting_learns(spark):
    rows = spark.range(2000).select((F.col("id") % 7).cast("double").alias("length"), (F.col("id") % 11).cast("double").alias("depth"), *[F.lit(0.0).alias(f) for f in urls.FEATURES if f not in ("length", "depth")])
    rows = rows.withColumn("y", F.when((F.col("length") > 3) != (F.col("depth") > 5), 1).otherwise(0))
    model = urls.boost(common.materialize(rows, "t"))
    wrong = rows.where((model.logit() > 0) != (F.col("y") == 1)).count()
    assert wrong < 40


def test_pipeline(spark, docs):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["toxicity", "simhash", "pii", "mixing", "packing"]
    d = docs
    seen = []
    for name, stage in p.STAGES:
        out = common.materialize(stage(spark, d, SMALL), name)
        if name != "packing":
            assert out.columns == list(p.COLUMNS)
        seen.append(out)
        d = out
    clean, one, masked, mixed, packed = seen
    model = toxicity.train(docs, common.table(spark, SMALL, "labels"))
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in toxicity.score(docs, model).where("predicted = 0").collect()}
    # the stage's rule is similarity 0.8 in five-word shingles, every pair compared; op3's three bits are its own query's
    assert {r.doc_id for r in one.collect()} == set(_lowest(_texts(clean)).values())
    assert masked.count() == one.count() and not any(_base(t) for _, t in _texts(masked))
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sum(words(t) for _, t in _texts(mixed)) == mixing.mixture(masked).agg(F.sum("taken")).first()[0]
    assert packed.where("piece = 0").count() == mixed.count()
    assert sorted(map(tuple, p.run(spark, SMALL).select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(tuple, packed.select("doc_id", "piece", "ids_crc32").collect()))
