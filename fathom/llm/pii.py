"""Personal data: exact base patterns, then bootstrapped contextual extraction. DataFrame functions only.

The regular expressions are linear-time forms of the four base patterns: a match can begin at the start of a run only (or
where the last match ended), runs are possessive, and nothing is repeated as a group, so neither very long runs nor very
long texts backtrack or recurse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, whole_text

KINDS = ("email", "ip", "card", "phone")
_JOIN = "￿"  # takes the place of a blank or hyphen between two digits, or of a dot between two parts of a host
_LOCAL, _HOST = r"A-Za-z0-9._%+\-", r"A-Za-z0-9\-"
EMAIL = rf"(?:(?<![{_LOCAL}{_JOIN}])|\G)[{_LOCAL}{_JOIN}]++@[{_HOST}]++{_JOIN}[{_HOST}{_JOIN}]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = rf"[0-9{_JOIN}]{{2,}}+"
PHONE = r"\+[0-9][ ().0-9\-]+[0-9]"
TOKEN = r"(?<![^\x20\x09-\x0D])(?=[^\x20\x09-\x0D0-9@]*+[0-9@])[^\x20\x09-\x0D]++"
_HIT = "array<struct<kind:int,i:int,gap:bigint,left:string,value:string,right:string>>"
_SPAN = "array<struct<kind:int,start:bigint,end:bigint,value:string,done:bigint>>"
_CHUNK = 1024
_TOKEN_KIND = 9


_WHITE = r"\x20\x09-\x0D"
#: Of what follows a match: the rest of its own word and the next word. Of what comes before, backwards: what is no letter or digit, and two words.
_AFTER = rf"^[^{_WHITE}]*+[{_WHITE}]++[^{_WHITE}]++"
_BEFORE = rf"^[^{_WHITE}\p{{L}}\p{{N}}]*+[{_WHITE}]++[^{_WHITE}]++(?:[{_WHITE}]++[^{_WHITE}]++)?+"


def _hits(text: Column, pattern: str, kind: int) -> Column:
    """The non-overlapping matches of a pattern, each with the length and the last two words of what precedes it and the first word of what follows, of any length."""
    context = lambda g: F.struct(F.length(g).cast("bigint").alias("n"), F.regexp_extract(g, _AFTER, 0).alias("head"), F.reverse(F.regexp_extract(F.reverse(g), _BEFORE, 0)).alias("tail"))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # without a match there is no context to look at
    gaps = F.when(F.rlike(text, F.lit(pattern)), F.transform(F.split(text, pattern, -1), context)).otherwise(F.array())
    rows = F.filter(F.zip_with(gaps, found, lambda g, v: F.struct(g.alias("g"), v.alias("v"))), lambda x: x["v"].isNotNull())
    rows = F.zip_with(rows, F.transform(F.slice(gaps, F.lit(2), F.size(gaps)), lambda g: g["head"]), lambda x, head: F.struct(x["g"].alias("g"), x["v"].alias("v"), head.alias("head")))
    return F.transform(rows, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), x["g"]["n"].alias("gap"), x["g"]["tail"].alias("left"), x["v"].alias("value"), x["head"].alias("right"))).cast(_HIT)


def hits(text: Column) -> Column:
    """Matches of the four base patterns and of identifier-like tokens. A text without a pattern's necessary characters skips it."""
    none = F.array().cast(_HIT)
    plain = F.translate(text, _JOIN, "￾")
    hosts = F.regexp_replace(plain, rf"(?<=[{_HOST}])\.(?=[{_HOST}])", _JOIN)
    digits = F.regexp_replace(plain, "(?<=[0-9])[ \\-](?=[0-9])", _JOIN)
    return F.concat(
        F.when(F.contains(text, F.lit("@")), _hits(hosts, EMAIL, 0)).otherwise(none),
        F.when(F.rlike(text, F.lit(r"[0-9]\.[0-9]")), _hits(text, IP, 1)).otherwise(none),
        F.when(F.rlike(text, F.lit("[0-9][ \\-]?[0-9]")), _hits(digits, CARD, 2)).otherwise(none),
        F.when(F.contains(text, F.lit("+")), _hits(text, PHONE, 3)).otherwise(none),
        F.when(F.rlike(text, F.lit("[0-9@]")), _hits(text, TOKEN, _TOKEN_KIND)).otherwise(none),
    )


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total, i):
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _valid_card(digits: Column) -> Column:
    return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)


def _valid_ip(x: Column) -> Column:
    parts = F.transform(F.split(x, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    return F.forall(parts, lambda p: F.when(F.length(p) > 3, False).otherwise(p.cast("int") <= 255))


def _shape(value: Column) -> Column:
    """Runs of digits, capitals and other letters by class and, for digits, length: 9{16}, a@a{9}.a."""
    x = F.regexp_replace(value, r"\p{Lu}+", "A")
    x = F.regexp_replace(x, r"[\p{L}&&[^A]]+", "a")
    return F.concat(F.regexp_replace(x, "[0-9]+", "9"), F.lit("#"), F.length(F.regexp_replace(value, "[^0-9]", "")))


def _word(x: Column) -> Column:
    return F.lower(F.regexp_replace(x, r"^[^\p{L}\p{N}=:]++|(?<=[\p{L}\p{N}=:])[^\p{L}\p{N}=:]++$", ""))


def mentions(found: DataFrame) -> DataFrame:
    """(__row, hits) -> (__row, kind, start, end, value, shape, w1, w2, w3): valid base spans, and with kind -1 the tokens that no base span overlaps.

    Offsets are running sums over a row's matches; overlaps come from running extremes over its spans in order. A token counts if
    its core, without outer punctuation, has an @ or at least four digits. w1, w2 and w3 are the word and the two words before and the
    word after."""
    h = found.where(F.size("hits") > 0).select("__row", F.explode("hits").alias("h")).select("__row", "h.*")
    before = F.sum(F.col("gap") + F.length("value")).over(Window.partitionBy("__row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)) - F.length("value")
    h = h.withColumn("start", before)
    token = F.col("kind") == _TOKEN_KIND
    core = F.regexp_replace("value", r"^[^\p{L}\p{N}]++$|^[^\p{L}\p{N}+]++|(?<=[\p{L}\p{N}])[^\p{L}\p{N}]++$", "")
    lead = F.length(F.regexp_extract("value", r"^[^\p{L}\p{N}+]*+", 0))
    h = h.withColumn("start", F.when(token, F.col("start") + lead).otherwise(F.col("start"))).withColumn("value", F.when(token, core).when(F.col("kind") == 0, F.translate("value", _JOIN, ".")).otherwise(F.col("value")))
    h = h.withColumn("end", F.col("start") + F.length("value")).withColumn("digits", F.regexp_replace("value", "[^0-9]", ""))
    valid = F.when(F.col("kind") == 0, True).when(F.col("kind") == 1, _valid_ip(F.col("value"))).when(F.col("kind") == 2, _valid_card(F.col("digits")))
    valid = valid.when(F.col("kind") == 3, F.length("digits").between(9, 15)).otherwise(F.contains("value", F.lit("@")) | (F.length("digits") >= 4))
    h = h.where(valid)
    base = F.col("kind") != _TOKEN_KIND
    order = Window.partitionBy("__row").orderBy("start")
    ends = F.max(F.when(base, F.col("end"))).over(order.rangeBetween(Window.unboundedPreceding, 0))
    # from the end backwards: a frame that only grows is one pass over a text's matches, a frame that shrinks is one for each
    starts = F.min(F.when(base, F.col("start"))).over(Window.partitionBy("__row").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0))
    h = h.withColumn("ends", ends).withColumn("starts", starts)
    h = h.where(base | ~(F.coalesce(F.col("ends") > F.col("start"), F.lit(False)) | F.coalesce(F.col("starts") < F.col("end"), F.lit(False))))
    edge = rf"[{_WHITE}]++[^{_WHITE}\p{{L}}\p{{N}}]*+$"
    w1 = _word(F.regexp_extract("left", rf"(?:^|[{_WHITE}])([^{_WHITE}]++){edge}", 1))
    w2 = F.lower(F.regexp_extract("left", rf"^([^{_WHITE}]++[{_WHITE}]++[^{_WHITE}]++){edge}", 1))
    w3 = _word(F.regexp_extract("right", rf"^[^{_WHITE}]*+[{_WHITE}]++([^{_WHITE}]++)", 1))
    kind = F.when(base, F.col("kind")).otherwise(-1)
    return h.select("__row", kind.alias("kind"), "start", "end", "value", _shape(F.col("value")).alias("shape"), w1.alias("w1"), w2.alias("w2"), w3.alias("w3"))


def _patterns(m: DataFrame) -> DataFrame:
    """Lexical patterns of a mention: its shape, alone or with the word before, the two words before, the word after, or those on either side."""
    p = [F.concat(F.lit("S|"), "shape"), F.when(F.col("w3") != "", F.concat(F.lit("R|"), "w3", F.lit("|"), "shape")), F.when(F.col("w1") != "", F.concat(F.lit("L|"), "w1", F.lit("|"), "shape")), F.when(F.col("w2") != "", F.concat(F.lit("LL|"), "w2", F.lit("|"), "shape")), F.when((F.col("w1") != "") & (F.col("w3") != ""), F.concat(F.lit("LR|"), "w1", F.lit("|"), "w3", F.lit("|"), "shape"))]
    return m.withColumn("pattern", F.explode(F.array_compact(F.array(*p))))


def annotate(docs: DataFrame, rounds: int = 3, confidence: float = 0.75, min_seeds: int = 3, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with two more columns: __base and __spans, arrays of (kind, start, end, value, done) - the base spans, and all spans; done is
    where the spans that begin before have ended.

    Bootstrapping: base spans are the seeds. Every mention (seed or other identifier-like token) gives lexical patterns from its shape and
    the words around it. Over the graph of patterns and instances, with counts as weights, scores spread in rounds: a
    pattern's confidence in a kind is the mean score of its instances (one pseudo-instance of score 0 added); an instance
    that is no seed takes the best confidence of its patterns that at least min_seeds distinct seeds support, damped by the round.
    Patterns that end at `confidence` or more discover the mentions that they match, as spans of the pattern's kind. Edges
    are counted per (pattern, instance) before they are joined, so a frequent phrase is one row. A row of docs is told from
    equal ones by a number written with it. Null text: no spans.
    """
    own = docs.columns
    numbered = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own) if keep_text or c != text_col], F.monotonically_increasing_id().alias("__row"), hits(whole_text(text_col)).alias("hits"))
    rows = materialize(numbered, "pii_rows")
    all_of = materialize(mentions(rows.select("__row", "hits")), "pii_mentions")
    m = _patterns(all_of)
    edges = m.groupBy("pattern", F.xxhash64("value").alias("instance"), "kind").agg(F.count("*").alias("n"))
    edges = materialize(edges, "pii_edges")
    seeds = edges.where("kind >= 0").groupBy("pattern", "kind").agg(F.count_distinct("instance").alias("seeds")).where(F.col("seeds") >= min_seeds)
    weight = edges.groupBy("pattern").agg(F.sum("n").alias("total"))
    score = edges.where("kind >= 0").groupBy("instance", "kind").agg(F.lit(1.0).alias("score"))
    fresh = edges.where("kind < 0").select("pattern", "instance", "n")
    conf = None
    for r in range(rounds):
        mass = edges.select("pattern", "instance", "n").join(score, "instance").groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("score")).alias("mass"))
        conf = mass.join(seeds, ["pattern", "kind"]).join(weight, "pattern").select("pattern", "kind", (F.col("mass") / (F.col("total") + 1)).alias("confidence"))
        conf = materialize(conf, "pii_patterns")
        if r < rounds - 1:
            gained = fresh.join(conf, "pattern").groupBy("instance", "kind").agg((F.max("confidence") * 0.9 ** (r + 1)).alias("score"))
            score = edges.where("kind >= 0").groupBy("instance", "kind").agg(F.lit(1.0).alias("score")).union(gained).groupBy("instance", "kind").agg(F.max("score").alias("score"))
            score = materialize(score, "pii_scores")  # a written side, not an aggregate: Spark may split the edges of a frequent instance
    strong = conf.where(F.col("confidence") >= confidence).groupBy("pattern").agg(F.max(F.struct("confidence", (-F.col("kind")).alias("k"))).alias("best")).select("pattern", F.col("best.confidence").alias("confidence"), (-F.col("best.k")).alias("as_kind"))
    strong = materialize(strong, "pii_strong")  # likewise for the mentions of a frequent pattern
    new = m.where("kind < 0").join(strong, "pattern").groupBy("__row", "start", "end", "value").agg(F.max(F.struct("confidence", "as_kind")).alias("best"))
    spans = all_of.where("kind >= 0").select("__row", F.struct("kind", "start", "end", "value").alias("x"), F.lit(True).alias("base"))
    spans = spans.union(new.select("__row", F.struct(F.col("best.as_kind").alias("kind"), "start", "end", "value"), F.lit(False)))
    earlier = Window.partitionBy("__row").orderBy("x.start", "x.end", "x.kind").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("done", F.coalesce(F.max("x.end").over(earlier), F.lit(0).cast("bigint"))).select("__row", F.struct("x.*", "done").alias("x"), "base")
    per = spans.groupBy("__row").agg(F.array_sort(F.collect_list(F.when(F.col("base"), F.col("x")))).alias("__base"), F.array_sort(F.collect_list("x")).alias("__spans")).withColumnRenamed("__row", "__r")
    none = F.array().cast(_SPAN)
    own_cols = [F.col(f"c{i}").alias(c) for i, c in enumerate(own) if keep_text or c != text_col]
    spare = rows.where(F.size("hits") == 0).select(*own_cols, none.alias("__base"), none.alias("__spans"))  # no match of any pattern: no join
    out = rows.where(F.size("hits") > 0).drop("hits").join(per.hint("merge"), F.col("__row") == F.col("__r"), "left")
    return spare.union(out.select(*own_cols, F.coalesce("__base", none).alias("__base"), F.coalesce("__spans", none).alias("__spans")))


def _listed(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(name, x["kind"] + 1), x["start"], x["end"])), ",")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans. Repeated rows each have a row; an empty table gives none."""
    found = annotate(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), keep_text=False, **options)
    of_kind = lambda k: F.size(F.filter("__base", lambda x: x["kind"] == k)).cast("long")
    count = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *count, F.sha2(_listed(F.col("__base")).cast("binary"), 256).alias("base_sha256"), _listed(F.col("__spans")).alias("spans"))


def _cut(chunks: Column, a: Column, b: Column) -> Column:
    """Characters a to b (end exclusive) of a text given as chunks of _CHUNK characters: only the chunks that they lie in are looked at."""
    i, j = F.floor(a / _CHUNK).cast("int"), F.floor((b - 1) / _CHUNK).cast("int")
    head = F.substring(F.element_at(chunks, i + 1), (a - i * _CHUNK + 1).cast("int"), F.when(i == j, (b - a).cast("int")).otherwise(_CHUNK))
    rest = F.concat(F.array_join(F.slice(chunks, i + 2, j - i - 1), ""), F.substring(F.element_at(chunks, j + 1), F.lit(1), (b - j * _CHUNK).cast("int")))
    return F.when(b <= a, "").when(i == j, head).otherwise(F.concat(head, rest))


def redact(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs with every span's text replaced by its kind in brackets; overlapping spans become one after the other, so nothing of either stays.

    Time is linear in a text's length and spans: the text is cut into chunks once, and a span costs a chunk. Null text stays null, texts
    without spans stay as they are; repeated rows each have a row; an empty table gives none."""
    own = docs.columns
    found = annotate(docs, text_col=text_col, **options)
    text, tags = F.col(f"`{text_col}`"), F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    found = found.withColumn("__s", F.array_sort(F.transform("__spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["done"].alias("done")))))
    found = found.withColumn("__chunks", F.when(F.size("__s") > 0, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))))
    chunks = F.col("__chunks")
    piece = lambda x: F.concat(_cut(chunks, x["done"], x["start"]), F.when(x["end"] > x["done"], F.element_at(tags, x["kind"] + 1)).otherwise(""))
    tail = _cut(chunks, F.array_max(F.transform("__s", lambda x: x["end"])), F.length(text).cast("bigint"))
    clean = F.when((F.size("__s") == 0) | text.isNull(), text).otherwise(F.concat(F.array_join(F.transform("__s", piece), ""), tail))
    return found.select(*[clean.alias(c) if c == text_col else F.col(f"`{c}`") for c in own])
