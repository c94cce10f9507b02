"""What becomes of extracted facts: merging, judging, gating and deduplication within an episode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import refdata as R
from ..functions import text as T


def judge(confidence: Column, status: Column | None = None, store: float = R.STORE_THRESHOLD, review: float = R.REVIEW_THRESHOLD) -> Column:
    return F.when(confidence >= store, "store").when(confidence >= review, "review").otherwise("discard")


def review_status(tier: Column) -> Column:
    """What a tier of normalization is stored as; an unnamed tier is pending."""
    return T.lookup(tier, R.TIER_STATUS, "pending")


def judged(facts: DataFrame, **limits: float) -> DataFrame:
    """Facts but the discarded; a fact for review is no longer confirmed."""
    out = facts.withColumn("action", judge(F.col("confidence"), **limits)).where("action <> 'discard'")
    return out.withColumn("review_status", F.when((F.col("action") == "review") & (F.col("review_status") == "confirmed"), "pending").otherwise(F.col("review_status")))


def by_confidence(facts: DataFrame, limit: float = R.HIGH_CONFIDENCE) -> DataFrame:
    return facts.withColumn("route", F.when(F.col("confidence") >= limit, "high").otherwise("low"))


def prefer_model(facts: DataFrame) -> DataFrame:
    """Low local candidates go where the model returned facts for the episode."""
    has = facts.where("source = 'llm'").select("episode_id").distinct().withColumn("__has", F.lit(True))
    out = by_confidence(facts).join(has, "episode_id", "left")
    return out.where((F.col("source") == "llm") | (F.col("route") == "high") | F.col("__has").isNull()).drop("__has", "route")


def merge(facts: DataFrame, group: list[str]) -> DataFrame:
    """One fact of each key: of local ones the last; the model's last replaces it. The first one's place is kept."""
    key = [*group, "__s", "__r", "__o"]
    own = facts.withColumns({"__s": F.lower("subject"), "__r": F.upper("relation"), "__o": F.lower("object")})
    w = Window.partitionBy(*key)
    rank = F.row_number().over(w.orderBy((F.col("source") == "llm").desc(), F.desc("ordinal")))
    return own.withColumns({"__n": rank, "position": F.min("ordinal").over(w)}).where("__n = 1").drop("__n", "__s", "__r", "__o")


def grounded(span: Column, text: Column) -> Column:
    t = T.strip(F.coalesce(span, F.lit("")))
    return (t != "") & F.contains(F.lower(T.strip(text)), F.lower(t))


def entity_type(obj: Column) -> Column:
    """What an object seems to be: an animal or an object by list, a location by its words or as one word with a capital; null if nothing tells."""
    low = F.lower(T.strip(obj))
    listed = low.isin(*R.NOT_LOCATIONS) | F.coalesce(T.head(obj).isin(*R.NOT_LOCATIONS), F.lit(False))
    place = obj.rlike(R.LOCATION_LIKE) | ((T.word_count(obj) == 1) & obj.rlike(r"^\p{Lu}"))
    return F.when(listed, F.when(low.isin(*R.ANIMALS), "animal").otherwise("object")).when(place, "location")


def lives_in_valid(relation: Column, obj: Column, span: Column) -> Column:
    """Residences are places: not animals or things by list, not those one lives with."""
    said = F.lower(F.coalesce(span, F.lit("")))
    bad = F.coalesce(entity_type(obj) != "location", F.lit(False))
    return (F.upper(relation) != "LIVES_IN") | ~(bad | F.contains(said, F.lit("live with")) | F.contains(said, F.lit("lives with")))


def pet_relation(relation: Column, span: Column) -> Column:
    low = F.lower(F.coalesce(span, F.lit("")))
    return F.when((relation == "LIVES_IN") & low.rlike(R.PET_LIVING) & low.rlike(R.PET), "HAS_PET").otherwise(relation)


def supported(text: Column, relation: Column, obj: Column) -> Column:
    """High-risk relations need their words near the object."""
    low, head = F.lower(text), T.quoted(T.head(obj))
    near = lambda verb: F.regexp_like(low, F.concat(F.lit(rf"\b(?:{verb})\b.{{0,40}}\b"), head, F.lit(r"\b")))
    return (
        F.when(relation == "BORN_IN", text.rlike(R.BORN) & F.contains(low, T.head(obj)))
        .when(relation == "LIVED_IN", near(r"(?:lived|living)\s+in"))
        .when(relation == "WORKED_AT", near(r"(?:worked|used to work)\s+(?:at|for)"))
        .otherwise(F.lit(True))
    )


def source_valid(text: Column, relation: Column, obj: Column) -> Column:
    rel, low, o = F.upper(relation), F.lower(T.strip(text)), T.strip(obj)
    tokens = F.filter(F.regexp_extract_all(F.lower(o), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) > 2)
    seen = (F.size(tokens) == 0) | F.exists(tokens, lambda t: F.contains(low, t))
    named = ~rel.isin(*R.BLACKLIST, *R.TRANSITIONS)
    ok = (low != "") & (o != "") & named & (T.word_count(o) <= R.OBJECT_WORDS_STORE) & seen
    return F.when(ok & rel.isin(*R.HIGH_RISK), supported(T.strip(text), rel, o)).otherwise(ok)


def gate(facts: DataFrame, text: str = "content", limit: float = R.CONFIDENCE_STORE_THRESHOLD) -> DataFrame:
    """facts with route: store, drop, or the reason for review; the first rule that hits counts."""
    c, has_text = F.col(text), F.coalesce(F.col(text), F.lit("")) != ""
    route = (
        F.when((F.coalesce("relation", F.lit("")) == "") | (T.strip(F.coalesce("object", F.lit(""))) == ""), "drop")
        .when(F.col("temporal_status") == "future", "future_fact_skipped")
        .when(has_text & ~grounded(F.col("source_span"), c), "ungrounded")
        .when(~lives_in_valid(F.col("relation"), F.col("object"), F.col("source_span")), "LIVES_IN object failed location validation")
        .when(F.col("confidence") < limit, "low_confidence")
        .when(~F.col("review_status").isin("confirmed", "fuzzy"), "drop")
        .when(has_text & ~source_valid(c, F.col("relation"), F.col("object")), "failed_source_validation")
        .otherwise("store")
    )
    return facts.withColumn("route", route)


def collapse_engagement(facts: DataFrame, group: list[str], order: str = "ordinal") -> DataFrame:
    """Of engagement relations with an object the most specific, in the place of the first; position orders the result."""
    rank = T.lookup(F.upper("relation"), R.ENGAGEMENT)
    own = facts.withColumns({"__rank": rank, "__s": F.lower(T.strip(F.col("subject"))), "__o": F.lower(T.strip(F.col("object")))})
    w = Window.partitionBy(*group, "__s", "__o", F.col("__rank").isNull())
    n = F.row_number().over(w.orderBy(F.desc("__rank"), order))
    at = F.when(F.col("__rank").isNull(), F.col(order)).otherwise(F.min(order).over(w))
    return own.withColumns({"__n": n, "position": at}).where("__rank IS NULL OR __n = 1").drop("__n", "__rank", "__s", "__o")


def dedupe_batch(facts: DataFrame, group: list[str], text: str | None = None) -> DataFrame:
    """One winner a slot, employment by object, then the rest; equal facts once, engagement collapsed. position orders each group."""
    rel, obj = F.upper("relation"), F.lower(T.strip(F.col("object")))
    employed = facts.where(rel == "WORKS_AT").select(*group).distinct().withColumn("__has", F.lit(True))
    own = facts.join(employed, group, "left").withColumns({"__rel": rel, "__obj": obj, "__slot": T.slot(F.col("relation"))})
    own = own.where(~F.col("__rel").isin(*R.TRANSITIONS) & (F.col("__has").isNull() | ~F.col("__rel").isin(*R.PAST_EMPLOYMENT)))
    section = F.when(F.col("__slot").isNotNull(), 0).when(F.col("__rel").isin(*[r for r, f in R.FAMILIES.items() if f == "employment"]), 1).otherwise(2)
    own = own.withColumn("__section", section)
    in_slot = Window.partitionBy(*group, "__slot")
    if text:
        has, place = F.coalesce(T.strip(F.col(text)), F.lit("")) != "", T.object_position(F.col(text), F.col("object"))
    else:
        has, place = F.lit(False), F.lit(0)
    role = F.when(F.col("__rel") == "HAS_ROLE", 2).when(F.col("__rel") == "IS", 1).otherwise(0)
    best = in_slot.orderBy(F.when(has, place).desc_nulls_last(), F.when(~has, role).desc_nulls_last(), F.when(~has, F.col("confidence")).desc_nulls_last(), F.when(has, F.col("ordinal")).otherwise(-F.col("ordinal")))
    by_object = Window.partitionBy(*group, "__section", "__obj").orderBy("ordinal")
    keep = F.when(F.col("__section") == 0, F.row_number().over(best) == 1).when(F.col("__section") == 1, F.row_number().over(by_object) == 1).otherwise(True)
    first = F.when(F.col("__section") == 0, F.min("ordinal").over(in_slot)).otherwise(F.col("ordinal"))
    kept = own.withColumns({"__keep": keep, "__first": first}).where("__keep")
    kept = kept.withColumn("__place", F.col("__section").cast("long") * 1_000_000_000 + F.col("__first"))
    once = F.row_number().over(Window.partitionBy(*group, F.lower("subject"), "__rel", "__obj").orderBy("__place"))
    kept = kept.withColumn("__n", once).where("__n = 1")
    out = collapse_engagement(kept, group, "__place")
    return out.drop(*(c for c in out.columns if c.startswith("__")))


def retraction_signal(text: Column, relation: Column, obj: Column, status: Column, preset: Column) -> Column:
    """Whether the text tells the fact as past."""
    low, head = F.lower(text), F.coalesce(T.head(obj), F.lit(""))
    at = F.instr(low, head) - 1
    start = F.greatest(at - 60, F.lit(0))
    near = F.substring(low, start + 1, at + F.length(head) + 20 - start)
    told = F.upper(relation).isin("WORKS_AT", "WORKED_AT", "LIVES_IN", "LIVED_IN") & (head != "") & (at >= 0) & near.rlike(R.PAST_TENSE)
    return F.coalesce(preset, F.lit(False)) | F.coalesce(status == "past", F.lit(False)) | (F.upper(relation) == "WORKED_AT") | F.coalesce(told, F.lit(False))


def category_signal(text: Column, uses: Column, hint: Column | None = None) -> Column:
    """USES where the text lists all tools and some current USES fact is there; a hint wins."""
    told = F.when(text.rlike(R.EXHAUSTIVE) & uses, "USES")
    return told if hint is None else F.coalesce(F.upper(F.when(hint != "", hint)), told)


def inferred_span(text: Column, span: Column, obj: Column) -> Column:
    """The span if given; else the clause around the object, else some characters around its first word."""
    low, o = F.lower(text), F.lower(T.strip(obj))
    at = F.instr(low, o) - 1
    before = F.substring(low, F.lit(1), at)
    start = F.greatest(T.last_position(before, F.lit(".")) + 1, T.last_position(before, F.lit(",")) + 1, F.lit(0))
    stop = F.instr(F.substring(low, at + 1, F.length(low)), ".") - 1
    end = F.when(stop < 0, F.length(text)).otherwise(at + stop)
    clause = T.strip(F.substring(text, start + 1, end - start))
    h = T.head(obj)
    p = F.instr(low, h) - 1
    left = F.greatest(p - 40, F.lit(0))
    window = T.strip(F.substring(text, left + 1, p + F.length(h) + 40 - left))
    given = T.strip(F.coalesce(span, F.lit("")))
    return F.when(given != "", given).when(F.coalesce(o, F.lit("")) == "", "").when(at >= 0, clause).when(p >= 0, window).otherwise("")


def clause_status(spans: DataFrame, clauses: DataFrame, on: list[str]) -> DataFrame:
    """spans (start, end, text) with the status of the clause that overlaps most, else of the shortest that holds the span, else unspecified."""
    c = clauses.select(*on, F.col("text").alias("c_text"), F.col("temporal_status").alias("c_status"), F.col("start").alias("c_start"), F.col("end").alias("c_end"), F.col("ordinal").alias("c_ordinal"))
    both = spans.join(c, on, "left")
    overlap = F.least("end", "c_end") - F.greatest("start", "c_start")
    located = (F.col("start") >= 0) & (F.col("c_start") >= 0)
    hit = F.struct(F.when(located & (overlap > 0), overlap).alias("n"), (-F.col("c_ordinal")).alias("p"), F.col("c_status").alias("s"))
    held = F.struct((-F.length("c_text")).alias("n"), (-F.col("c_ordinal")).alias("p"), F.col("c_status").alias("s"))
    inside = F.contains(F.lower("c_text"), F.lower(T.strip(F.col("span"))))
    keys = [F.col(x) for x in spans.columns]
    best = both.groupBy(*keys).agg(F.max(F.when(hit["n"].isNotNull(), hit)).alias("a"), F.max(F.when(inside, held)).alias("b"))
    return best.select(*spans.columns, F.coalesce("a.s", "b.s", F.lit("unspecified")).alias("temporal_status"))


def with_temporal(facts: DataFrame, found: Column) -> DataFrame:
    """A preset status stays; unspecified is current; the past is retracted."""
    preset = F.col("temporal_status")
    status = F.when(preset.isNotNull() & (preset != "unspecified"), preset).otherwise(found)
    status = F.when(status == "unspecified", "current").otherwise(status)
    return facts.withColumn("temporal_status", status).withColumn("retraction_signal", F.col("retraction_signal") | (F.col("temporal_status") == "past"))
