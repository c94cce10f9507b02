"""Personal data: known forms, and identifiers discovered by bootstrapped contexts, by DataFrame functions alone.

Mentions are known entities and other strings with a digit or an at sign. A mention's patterns are the two and three
words before it, those after it, and one on each side; the word next to it is a word, not another mention or an end of the
text. Its instance is its value. Values that hold a known form are seeds of that kind with score 1. In each round a
pattern's share, for each shape of mentions, is the sum of its distinct instances' scores by their number, smoothed, and
its score that share times the logarithm of the sum: much evidence outweighs instances not yet known. Words that stand
beside anything, as frequent ones do, tell nothing: the kinds of a pattern's instances must differ from those of all seeds
by more than chance gives among so many patterns (a likelihood ratio; where all seeds are of one kind it isn't asked). A pattern whose share, score and ratio reach their
limits, and which enough distinct seeds or instances accepted before support, names its instances of that shape; these get
the share and the kind of their best pattern and lend support to further patterns. A mention that is no known form is found
where one of its patterns reaches the limits in the last round.

Edge cases: null and empty texts have no spans; null and repeated doc_ids are scanned row by row, and equal instances in
many rows count once for a pattern; an empty table gives no rows; words of any length count whole; time grows with a text's
length; other columns are ignored by ``report`` and kept by ``redact``, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, materialize, row_hashes, small, text_or_empty
from .spans import SPANS, find_spans, let, listed, none, redacted, span, split_by

KINDS = ("email", "ip", "card", "phone", "context")
#: An expression starts at its run's first character, or where the match before ended, and never gives back.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
IP_VALID = rf"^{OCTET}(?:\.{OCTET}){{3}}$"
#: A known form, or a string without white space that holds a digit or an at sign.
MENTION = rf"{PHONE}|(?<![0-9])[0-9](?:[\x20-]?[0-9]){{13,}}+|(?<![^\s])[^\s0-9@]*+[0-9@][^\s]*+"
#: Words of a pattern at most; in their place another mention, the text's start and its end.
WORDS, MENTIONED, START, END = 3, "#", "^", "$"
SHAPES = 3
#: Distinct seeds or accepted instances that a pattern needs, the share and the score from which it names instances, its prior count, and the rounds.
SUPPORT, SHARE, CONFIDENT, PRIOR, ROUNDS = 4, 0.3, 0.8, 0.5, 3
#: What the likelihood ratio must exceed twice the logarithm of the number of patterns by; seeds of each kind that count beforehand.
MARGIN, EVEN = 6.0, 1.0


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether a string of digits, separators aside, passes the Luhn check."""
    d = F.reverse(digits(value))

    def add(acc: Column, i: Column) -> Column:
        x = F.substring(d, i, 1).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return (acc + F.when(x > 9, x - 9).otherwise(x)).cast("int")

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0


def is_card(value: Column) -> Column:
    return F.when(F.length(digits(value)).between(14, 19), luhn(value)).otherwise(F.lit(False))


def is_phone(value: Column) -> Column:
    return F.length(digits(value)).between(10, 15)


def known(text: Column) -> Column:
    number = text.rlike("[0-9]")
    return F.concat(
        F.when(F.contains(text, F.lit("@")), find_spans(text, EMAIL, 0)).otherwise(none()),
        F.when(number & F.contains(text, F.lit(".")), F.filter(find_spans(text, IP, 1), lambda x: x["value"].rlike(IP_VALID))).otherwise(none()),
        F.when(number, F.filter(find_spans(text, CARD, 2), lambda x: is_card(x["value"]))).otherwise(none()),
        F.when(F.contains(text, F.lit("+")), F.filter(find_spans(text, PHONE, 3), lambda x: is_phone(x["value"]))).otherwise(none()),
    )


MENTIONS = "array<struct<start:int,end:int,value:string,left:array<string>,right:array<string>>>"


def mentions(text: Column) -> Column:
    """start, end, value, and the words before and after, nearest last and first: of up to WORDS words those with letters or digits, lower-case, without points at their ends."""

    def plain(w: Column) -> Column:
        return F.filter(F.transform(w, lambda x: F.regexp_replace(F.lower(x), r"^[^\p{L}\p{N}]++|(?<![^\p{L}\p{N}])[^\p{L}\p{N}]++$", "")), lambda x: x != "")

    def words(part: Column) -> Column:
        near = lambda w: F.struct(plain(F.slice(w, 1, WORDS)).alias("first"), plain(F.slice(w, F.greatest(F.size(w) - WORDS + 1, F.lit(1)), WORDS)).alias("last"))
        return let(F.filter(F.split(part, r"\s+"), lambda w: w != ""), near)

    def each(v: Column) -> Column:
        def one(m: Column, k: Column) -> Column:
            left = F.concat(F.array(F.when(k == 0, START).otherwise(MENTIONED)), F.get(v["ends"], k)["last"])
            right = F.concat(F.get(v["ends"], k + 1)["first"], F.array(F.when(k == F.size(v["match"]) - 1, END).otherwise(MENTIONED)))
            at = F.get(v["at"], k)
            return F.struct(at.alias("start"), (at + F.length(m)).cast("int").alias("end"), m.alias("value"), left.alias("left"), right.alias("right"))

        return F.transform(v["match"], one)

    split = let(split_by(text, MENTION), lambda v: F.struct(v["match"].alias("match"), v["at"].alias("at"), F.transform(v["part"], words).alias("ends")))
    return F.when(text.rlike("[0-9@]"), let(split, each)).otherwise(F.array().cast(MENTIONS)).cast(MENTIONS)


def shape(value: Column) -> Column:
    """The kind of a mention's characters, wide enough to hold known forms and their unseen kin: 0 an address, 1 a number, 2 others."""
    return F.when(F.contains(value, F.lit("@")), 0).when(value.rlike("^[0-9 ().+:/-]+$"), 1).otherwise(2)


def patterns_of(m: Column) -> Column:
    """A digest of the nearest words: two to WORDS of each side, and one on both."""
    before, after = F.element_at(m["left"], -1), F.element_at(m["right"], 1)
    word = lambda x: ~x.isin(MENTIONED, START, END)
    digest = lambda name, words: F.md5(F.concat_ws("\x01", F.lit(name), words))
    sizes = range(2, WORDS + 1)
    left = [F.when(word(before) & (F.size(m["left"]) >= k), digest("left", F.slice(m["left"], -k, k))) for k in sizes]
    right = [F.when(word(after) & (F.size(m["right"]) >= k), digest("right", F.slice(m["right"], 1, k))) for k in sizes]
    return F.array_compact(F.array(*left, *right, F.when(word(before) & word(after), digest("both", F.array(before, after)))))


def confident_patterns(edges: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, least: float = SHARE, confident: float = CONFIDENT, prior: float = PRIOR, margin: float = MARGIN) -> DataFrame:
    """(pattern, shape) at or over the limits; edges are distinct (pattern, instance, shape, kind), kind being null but for seeds."""
    seeds = materialize(edges.where("kind IS NOT NULL").groupBy("instance").agg(F.max("kind").alias("kind"), F.lit(1.0).alias("score")))
    kinds = len(KINDS) - 1
    sizes = {r["kind"]: r["count"] for r in seeds.groupBy("kind").count().collect()}  # at most a row a kind
    usual = [(sizes.get(k, 0) + EVEN) / (sum(sizes.values()) + kinds * EVEN) for k in range(kinds)]
    instances = seeds
    for r in range(rounds):
        scored = instances.select(F.col("instance").alias("i"), F.col("kind").alias("k"), "score")
        weighed = edges.select("pattern", "instance", "shape").join(scored, F.col("instance") == F.col("i"), "left")
        of = lambda c: F.sum(F.when(c, F.coalesce("score", F.lit(0.0))).otherwise(0.0))
        by_shape = (F.struct(F.lit(s).alias("shape"), of(F.col("shape") == s).alias("sum"), F.count_if(F.col("shape") == s).alias("n"), F.count_if((F.col("shape") == s) & F.col("k").isNotNull()).alias("accepted")) for s in range(SHAPES))
        sums = weighed.groupBy("pattern").agg(F.array(*by_shape).alias("shapes"), F.array(*(of(F.col("k") == k) for k in range(kinds))).alias("kinds"))
        whole = F.aggregate("kinds", F.lit(0.0), lambda a, x: a + x)
        ratio = F.aggregate(F.zip_with("kinds", F.array(*map(F.lit, usual)), lambda x, u: F.when(x > 0, 2 * x * F.ln(x / (whole * u))).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
        sums = sums.select("pattern", ratio.alias("ratio"), (F.array_position("kinds", F.array_max("kinds")) - 1).cast("int").alias("kind"), F.explode("shapes").alias("s")).where(F.col("s.accepted") >= support)
        share = F.col("s.sum") / (F.col("s.n") + prior)
        sums = materialize(sums.select("pattern", "s.shape", "kind", "ratio", share.alias("share"), (share * F.log2("s.sum")).alias("score")))
        limit = 2 * math.log(max(1, sums.count())) + margin if len(sizes) > 1 else -math.inf
        patterns = materialize(sums.where((F.col("score") >= confident) & (F.col("share") >= least) & (F.col("ratio") >= limit)).select("pattern", "shape", "share", "kind"))
        discard(sums, instances if r else None)
        if r + 1 < rounds:
            named = edges.where("kind IS NULL").select("pattern", "instance", "shape").join(patterns, ["pattern", "shape"])
            best = named.groupBy("instance").agg(F.max(F.struct("share", "kind")).alias("b")).select("instance", "b.kind", F.col("b.share").alias("score"))
            instances = materialize(seeds.unionByName(best))
            discard(patterns)
    discard(seeds)
    return patterns


def weight(spans: str) -> Column:
    return F.aggregate(spans, F.lit(96), lambda a, x: a + F.length(x["value"]) * 4 + 64)


def discovered(kept: DataFrame) -> DataFrame:
    """(k1, k2, more): the spans that contexts name, of texts (k1, k2, mentions); equal texts once."""
    each = kept.where(F.size("mentions") > 0).select("k1", "k2", F.explode("mentions").alias("m"))
    kind = F.get(known(F.col("m.value")), 0)["kind"]
    each = materialize(each.select("k1", "k2", "m.start", "m.end", "m.value", patterns_of(F.col("m")).alias("patterns"), shape(F.col("m.value")).alias("shape"), kind.alias("kind")))
    edges = materialize(each.select(F.explode("patterns").alias("pattern"), F.md5("value").alias("instance"), "shape", "kind").distinct())
    patterns = confident_patterns(edges)
    unseen = each.where("kind IS NULL").select("k1", "k2", "start", "end", "value", "shape", F.explode("patterns").alias("pattern"))
    named = unseen.join(small(patterns.select("pattern", "shape"), F.lit(64)), ["pattern", "shape"]).select("k1", "k2", span(F.col("start"), F.col("end"), 4, F.col("value")).alias("x"))
    more = materialize(named.groupBy("k1", "k2").agg(F.collect_set("x").cast(SPANS).alias("more")))
    discard(each, edges, patterns)
    return more


def _scanned(docs: DataFrame, text_col: str, *columns: Column) -> DataFrame:
    text = text_or_empty(text_col)
    return docs.select(*columns, *(h.alias(k) for h, k in zip(row_hashes(F.col(text_col).cast("string")), ("k1", "k2"), strict=True)), known(text).alias("base"), mentions(text).alias("mentions"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kept = materialize(_scanned(docs, "text", F.col("doc_id")))
    more = small(discovered(kept), weight("more"))
    found = kept.drop("mentions").join(more, ["k1", "k2"], "left").withColumn("more", F.coalesce("more", none()))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{KINDS[k]}") for k in range(4)),
        F.sha2(listed(F.col("base"), KINDS), 256).alias("base_sha256"), listed(F.concat("base", "more"), KINDS).alias("spans"), F.size("more").cast("long").alias("n_context"),
    )


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with personal data replaced by its kind in square brackets; other texts, nulls included, stay."""
    kept = materialize(_scanned(docs, text_col).where((F.size("base") > 0) | (F.size("mentions") > 0)))  # few texts have any
    more = small(discovered(kept), weight("more"))
    spans = kept.drop("mentions").join(more, ["k1", "k2"], "left").select("k1", "k2", F.concat("base", F.coalesce("more", none())).alias("spans"))
    spans = materialize(spans.where(F.size("spans") > 0).dropDuplicates(["k1", "k2"]))
    discard(kept, more)
    a, b, found = (fresh(docs, c) for c in ("first_hash", "second_hash", "found_spans"))
    own = docs.withColumns(dict(zip((a, b), row_hashes(F.col(text_col).cast("string")), strict=True)))
    spans = small(spans, weight("spans")).select(F.col("k1").alias(a), F.col("k2").alias(b), F.col("spans").alias(found))
    text = F.when(F.col(found).isNotNull(), redacted(F.col(text_col), F.col(found), KINDS)).otherwise(F.col(text_col))
    return own.join(spans, [a, b], "left").withColumn(text_col, text).select(*docs.columns)


def op9_pii(spark, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
