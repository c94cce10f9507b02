"""Secret scans: known forms, and windows of high entropy, by DataFrame functions alone.

Strings of key characters with both letters and digits are candidates. A window slides over each; its characters'
counts, packed into a few integers, change by one that enters and one that leaves, and its Shannon entropy with them. A
candidate with a window over the limit of its character class is a secret from its first such window to its last, unless
the allow-list names it. Known forms stay beside it, also where they overlap it: a form that is random too is found twice.

Edge cases: null and empty texts have no spans; null and repeated doc_ids are scanned row by row; an empty table gives
no rows; time grows with a text's length; other columns are ignored by ``report`` and kept by ``redact``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, text_or_empty
from .spans import find_spans, let, listed, none, redacted, span

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
#: Characters in a window, and of each class of candidates the bits above which a window is a secret.
WINDOW = 20
CLASSES = (("hex", "^(?:[0-9a-f]++|[0-9A-F]++)=*$", 3.0), ("upper", "^[A-Z0-9+/_-]++=*$", 3.6), ("lower", "^[a-z0-9+/_-]++=*$", 3.7), ("mixed", "", 3.7))
KEY = "[A-Za-z0-9+/_-]"
CANDIDATE = rf"(?<!{KEY})(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z]){KEY}{{{WINDOW},}}+={{0,2}}+"
#: The first of the characters that are counted, and how many there are from it: + to z.
FIRST, SYMBOLS = ord("+"), ord("z") - ord("+") + 1
#: Candidates that are no secrets: identifiers by rule.
IDENTIFIERS = (r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",)
#: Stretches of windows that are none: names for show, a word with a number, words with separators and numbers, paths.
ALLOWED = (
    r"(?i)example|sample|dummy|placeholder|changeme|your[_-]",
    r"^[A-Za-z]+[0-9]{1,4}$",
    r"^[A-Za-z]*+(?:[+/_=-]++(?:[A-Za-z]++|[0-9]++)?+)*+$",
)


def window_entropy(chars: Column, window: int, limit: Column) -> Column:
    """(first, last): the starts of the first and the last window over the limit, from 0; null if none is. chars: an array of characters from + to z."""
    bits = window.bit_length()  # of a count; each integer holds several
    each = 62 // bits
    units = F.array(*(F.lit(1 << bits * k) for k in range(each))).cast("array<long>")
    x_log = lambda c: F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))
    word = lambda s: ((s - s % each) / each).cast("int")
    count = lambda n, s: F.call_function("shiftright", F.get(n, word(s)), (s % each) * bits).bitwiseAND((1 << bits) - 1)

    def entropy(v: Column) -> Column:
        c = v["chars"]
        symbol = lambda i: F.ascii(F.get(c, i - 1)) - FIRST

        def step(acc: Column, i: Column) -> Column:
            enters, leaves = symbol(i), F.when(i > window, symbol(i - window)).otherwise(F.lit(-1))
            gone = F.when(leaves >= 0, count(acc["n"], leaves)).otherwise(F.lit(0))
            less = acc["s"] - x_log(gone) + x_log(gone - 1)
            now = count(acc["n"], enters) - F.when(enters == leaves, 1).otherwise(0)
            s = less - x_log(now) + x_log(now + 1)
            over = (i >= window) & (F.log2(F.lit(float(window))) - s / window > v["limit"])
            unit = lambda x, k: F.when((x >= 0) & (word(x) == k), F.get(units, x % each)).otherwise(F.lit(0))
            n = F.transform(acc["n"], lambda x, k: x + unit(enters, k) - unit(leaves, k))
            return F.struct(
                n.alias("n"), s.alias("s"),
                F.when(over & acc["first"].isNull(), i - window).otherwise(acc["first"]).alias("first"),
                F.when(over, i - window).otherwise(acc["last"]).alias("last"),
            )

        zero = F.struct(F.array_repeat(F.lit(0).cast("long"), -(-SYMBOLS // each)).alias("n"), F.lit(0.0).alias("s"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))
        return F.aggregate(F.sequence(F.lit(1), F.size(c)), zero, step, lambda acc: F.struct(acc["first"], acc["last"]))

    return let(F.struct(chars.alias("chars"), limit.alias("limit")), entropy)


def limit_of(value: Column) -> Column:
    out = F.lit(CLASSES[-1][2])
    for _, pattern, limit in reversed(CLASSES[:-1]):
        out = F.when(value.rlike(pattern), limit).otherwise(out)
    return out


def named(value: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | value.rlike(p)
    return out


def scan(docs: DataFrame, out: str, text_col: str = "text", allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """docs with a struct column out: base (spans of known forms) and more (spans by entropy)."""
    text = text_or_empty(text_col)
    low = F.lower(text)
    told = F.contains(low, F.lit("passw")) | F.contains(low, F.lit("secret")) | F.contains(low, F.lit("token")) | F.contains(low, F.lit("api"))
    assign = F.filter(find_spans(text, ASSIGN, 0), lambda x: F.length(F.regexp_extract(x["value"], ASSIGN, 2)) >= 6)
    base = F.concat(
        F.when(told, assign).otherwise(none()),
        F.when(F.contains(text, F.lit("AKIA")), find_spans(text, ACCESS, 1)).otherwise(none()),
        F.when(text.rlike("[0-9a-f]{24}"), find_spans(text, HEX, 2)).otherwise(none()),
    )

    def stretch(x: Column) -> Column:
        at = window_entropy(F.split(x["value"], ""), WINDOW, limit_of(x["value"]))
        return let(at, lambda w: span(x["start"] + w["first"], x["start"] + w["last"] + WINDOW, 3, F.substring(x["value"], w["first"] + 1, w["last"] - w["first"] + WINDOW)))

    candidates = F.filter(find_spans(text, CANDIDATE, 3), lambda x: ~named(x["value"], IDENTIFIERS))
    more = F.filter(F.transform(candidates, stretch), lambda x: x["start"].isNotNull() & ~named(x["value"], allowed))
    return docs.withColumn(out, F.struct(base.alias("base"), F.when(text.rlike(CANDIDATE), more).otherwise(none()).alias("more")))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    found = scan(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), "found").select("doc_id", "found.*")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed(F.col("base"), KINDS), 256).alias("base_sha256"), listed(F.concat("base", "more"), KINDS).alias("spans"), F.size("more").cast("long").alias("n_entropy"),
    )


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with secrets replaced by their kind; other texts, nulls included, stay."""
    out = fresh(docs, "found")
    spans = F.concat(F.col(out)["base"], F.col(out)["more"])
    text = F.when(F.size(spans) > 0, redacted(F.col(text_col), spans, KINDS)).otherwise(F.col(text_col))
    return scan(docs, out, text_col).withColumn(text_col, text).select(*docs.columns)


def op2_secret_scans(spark, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
