"""Spans of regular expressions in code points, by DataFrame functions alone.

A text is split by an expression; the lengths of the parts and of the matches between them give every match's place.
Spans are structs (start, end, kind, value); the end is exclusive and kind is a number. Time grows with a text's length
and number of matches: running sums go by blocks, as a growing array is copied at each step.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,kind:int,value:string>"
SPANS = f"array<{SPAN}>"
#: Elements of a running value's block, and code points of a text's part.
BLOCK, PART = 256, 4096


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, which is evaluated once: within lambdas nothing else keeps an expression from being evaluated again."""
    return F.element_at(F.transform(F.array(x), f), 1)


def running(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """For each of an array of integers what the ones before it add up to, from 0."""
    zero, none_yet = F.lit(0), F.array().cast("array<int>")

    def step(acc: Column, x: Column) -> Column:
        return F.struct(add(acc["at"], x).cast("int").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def within(v: Column, head: Column | None = None) -> Column:
        start = F.struct((zero if head is None else head).cast("int").alias("at"), none_yet.alias("out"))
        return F.aggregate(v, start, step, lambda acc: acc["out"])

    def blocks(v: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(v), F.lit(BLOCK))
        totals = F.transform(starts, lambda b: F.aggregate(F.slice(v, b + 1, BLOCK), zero, lambda a, x: add(a, x).cast("int")))
        return let(within(totals), lambda heads: F.flatten(F.transform(starts, lambda b, k: within(F.slice(v, b + 1, BLOCK), F.get(heads, k)))))

    return let(values, lambda v: F.when(F.size(v) <= BLOCK, within(v)).otherwise(blocks(v)))


def sums(values: Column) -> Column:
    return running(values, lambda a, x: a + x)


def none() -> Column:
    return F.array().cast(SPANS)


def span(start: Column, end: Column, kind: Column | int, value: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), (kind if isinstance(kind, Column) else F.lit(kind)).cast("int").alias("kind"), value.alias("value"))


def split_by(text: Column, pattern: str) -> Column:
    """(part, match, at): the parts around all leftmost matches that don't overlap, the matches, and where these start."""
    both = F.struct(F.split(text, pattern, -1).alias("part"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))

    def placed(v: Column) -> Column:
        before = sums(F.transform(v["match"], lambda m, k: F.length(F.get(v["part"], k)) + F.length(m)))
        at = let(before, lambda b: F.transform(b, lambda x, k: (x + F.length(F.get(v["part"], k))).cast("int")))
        return F.struct(v["part"].alias("part"), v["match"].alias("match"), at.alias("at"))

    return let(both, placed)


def find_spans(text: Column, pattern: str, kind: int) -> Column:
    """All leftmost matches that don't overlap."""
    return let(split_by(text, pattern), lambda v: F.transform(v["match"], lambda m, k: span(F.get(v["at"], k), F.get(v["at"], k) + F.length(m), kind, m)))


def listed(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    names = F.array(*(F.lit(k) for k in kinds))
    return F.array_join(F.transform(ordered(spans), lambda x: F.concat(names[x["kind"]], F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), ",")


def ordered(spans: Column) -> Column:
    """Sorted by start, then kind; ends and values come after the kind."""
    keyed = F.transform(spans, lambda x: F.struct(x["start"], x["kind"], x["end"], x["value"]))
    return F.transform(F.array_sort(keyed), lambda x: span(x["start"], x["end"], x["kind"], x["value"]))


def redacted(text: Column, spans: Column, kinds: tuple[str, ...]) -> Column:
    """The text with each span, or each run of overlapping spans, replaced by its first kind in square brackets."""
    names = F.array(*(F.lit(f"[{k}]") for k in kinds))

    def cut(parts: Column, a: Column, b: Column) -> Column:
        """Code points a to b: the parts that hold them, joined, without what is before and after."""
        first = F.floor(a / PART).cast("int")
        joined = F.array_join(F.slice(parts, first + 1, F.floor((b - 1) / PART).cast("int") - first + 1), "")
        return F.when(b > a, F.substring(joined, a - first * PART + 1, b - a)).otherwise("")

    def replaced(v: Column) -> Column:
        x, ends, parts = v["x"], v["ends"], v["parts"]  # ends: of the spans before
        pieces = F.transform(x, lambda y, k: F.when(y["start"] >= F.get(ends, k), F.concat(cut(parts, F.get(ends, k), y["start"]), names[y["kind"]])).otherwise(""))
        last = F.greatest(F.element_at(ends, -1), F.element_at(x, -1)["end"])
        return F.concat(F.array_join(pieces, ""), cut(parts, last, v["n"]))

    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))
    both = let(ordered(spans), lambda x: F.struct(x.alias("x"), running(F.transform(x, lambda y: y["end"]), F.greatest).alias("ends"), parts.alias("parts"), F.length(text).alias("n")))
    return F.when(F.size(spans) > 0, let(both, replaced)).otherwise(text)
