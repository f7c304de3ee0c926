
import re

import pytest

from fathom.llm import shingles

SMALL = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def _set(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def _lowest(rows):
    """(id, text) -> the smallest id of each id's group, every pair compared."""
    low = {i: i for i, _ in rows}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    sets = [(i, _set(t)) for i, t in rows]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((root(i), root(j)))
                low[y] = x
    return {i: root(i) for i, _ in rows}


def _crowd():
    """A large group of near copies, chains at and beside the limit, copies, short and empty texts."""
    import random

    r = random.Random(5)
    word = lambda: f"w{r.randrange(5000)}"
    base = [word() for _ in range(120)]
    texts = [" ".join(w if r.random() > 0.008 else word() for w in base) for _ in range(60)]
    for n in range(1, 40):
        t = [word() for _ in range(n)]
        texts += [" ".join(t), " ".join([*t, word()]), " ".join([*t, *(word() for _ in range(n // 4))]).upper()]
    return [*texts, texts[3], "", " ", "one", "One"]


@pytest.mark.parametrize("reach", [1, 3])
def test_similar_groups(spark, reach):
    rows = list(enumerate(_crowd(), 1))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in shingles.similar_groups(df, reach=reach, sample=50).collect()}
    assert got == _lowest(rows)
    assert shingles.similar_groups(df.limit(0)).count() == 0


def test_pipeline_drops_near_copies(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    low = _lowest([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert {r.doc_id for r in p.drop_near_duplicates(spark, docs, SMALL).collect()} == set(low.values())


def test_one_row_of_each_group(spark):
    import corpus_pipeline as p

    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a), (1, a), (1, b), (0, b + " x"), (None, a), (None, "c d"), (None, "c d"), (7, "e"), (7, "f"), (None, None), (8, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], COLUMNS).repartition(3)
    got = sorted(((r.doc_id, r.text) for r in p.drop_near_duplicates(spark, df, SMALL).collect()), key=str)
    assert got == sorted([(0, b + " x"), (1, a), (7, "e"), (7, "f"), (8, ""), (None, "c d")], key=str)
