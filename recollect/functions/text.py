"""Scalar normalizers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import refdata as R


def lookup(key: Column, table: dict, default: object = None) -> Column:
    """A small constant table as one CASE, inside code generation; no join."""
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def words(x: Column) -> Column:
    return F.array_remove(F.split(x, r"\s+"), "")


def word_count(x: Column) -> Column:
    return F.size(words(x))


def trim_object(x: Column, n: int = R.OBJECT_WORDS_EXTRACT) -> Column:
    """The first n words, without punctuation at either end of the whole."""
    return F.array_join(F.slice(words(F.regexp_replace(strip(x), "^[.,;:!?]+|[.,;:!?]+$", "")), 1, n), " ")


def canonical_token(x: Column) -> Column:
    return F.upper(F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), "^_+|_+$", ""))


def alias_key(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


#: Objects are equal if their keys are.
object_key = alias_key


def subject(x: Column) -> Column:
    """First-person words and blanks become the user."""
    t = F.lower(F.trim(x))
    return F.when(x.isNull() | t.isin("", "i", "me", "my", "myself", "user"), "user").otherwise(strip(x))


def fact_string(s: Column, relation: Column, obj: Column) -> Column:
    return F.concat_ws(" ", s, F.lower(F.replace(relation, F.lit("_"), F.lit(" "))), obj)


def token_count(x: Column) -> Column:
    """The estimate of a quarter of the characters, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(x) / 4)).cast("long")


def timestamp(x: Column) -> Column:
    """An ISO time without its zone; null if it isn't one."""
    return F.try_to_timestamp(F.regexp_replace(strip(x), r"(Z|[+-]\d{2}:?\d{2})$", "")).cast("timestamp_ntz")


def head(x: Column) -> Column:
    return F.lower(F.get(words(x), 0))


def last_position(text: Column, part: Column) -> Column:
    """Where the last occurrence starts, from 0; -1 if there is none."""
    at = F.instr(F.reverse(text), F.reverse(part)) if not isinstance(part, str) else F.instr(F.reverse(text), part[::-1])
    return F.when(part.isNull() | (part == "") | (at == 0), -1).otherwise(F.length(text) - at - F.length(part) + 1)


def object_position(text: Column, obj: Column) -> Column:
    return last_position(F.lower(text), F.coalesce(head(obj), F.lit("")))


def quoted(x: Column) -> Column:
    """A string as a literal within an expression."""
    return F.regexp_replace(x, r"([\\\[\]{}()*+?.^$|\-#&~ ])", r"\\$1")


def slot(relation: Column) -> Column:
    return lookup(F.upper(relation), R.SLOTS)


def family(relation: Column) -> Column:
    return lookup(F.upper(relation), R.FAMILIES)


def behavior(relation: Column) -> Column:
    return lookup(F.upper(relation), R.BEHAVIOR, R.DEFAULT_BEHAVIOR)


def supersedes(new: Column, old: Column) -> Column:
    out = F.lit(False)
    for k, own in R.SUPERSEDES.items():
        out = out | ((F.upper(new) == k) & F.upper(old).isin(*own))
    return out


def is_technology(x: Column) -> Column:
    t = F.lower(strip(x))
    plain = ~x.rlike(R.COMPANY_LIKE) & (word_count(t) == 1) & (F.length(t) <= 20) & t.rlike(r"^[\x00-\x7F]*$")
    return t.isin(*R.TECHNOLOGY) | plain


def profile_value(relation: Column, obj: Column) -> Column:
    """The object as a profile's value; null where it is too long for its relation."""
    t = strip(obj)
    role = F.regexp_replace(t, r"(?i)^(?:an?|the)\s+", "")
    value = (
        F.when(relation.isin("IS", "HAS_ROLE"), F.when(word_count(role) <= 6, role))
        .when(relation == "WORKS_AT", F.when(word_count(t) <= 4, t))
        .when(relation == "WORKS_ON", F.when(word_count(t) <= 12, t))
        .when(relation == "GOAL_IS", F.when(F.length(t) <= 200, t))
        .otherwise(t)
    )
    return F.when(value != "", value)


def pair_confidence(a: Column, b: Column) -> Column:
    return F.coalesce(F.least(a, b), F.lit(R.MISSING_PAIR_CONFIDENCE))


def sentences(x: Column) -> Column:
    """Parts after a full stop, an exclamation or a question mark and white space; blank parts go."""
    return F.filter(F.transform(F.split(x, r"(?<=[.!?])\s+"), strip), lambda s: s != "")


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    v = full = (1 << len(a)) - 1
    for c in b:
        u = v & at.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def ratio(a: str, b: str) -> float:
    """1 less the share of characters to insert or delete."""
    return 2 * _common(a, b) / (len(a) + len(b)) if a or b else 1.0


def similarity(a: str | None, b: str | None) -> float | None:
    """The better of the ratio as it stands and that of sorted words."""
    if a is None or b is None:
        return None
    return max(ratio(a, b), ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))))
