"""Relation names from phrases: exact, fuzzy and by meaning; and what becomes of unknown ones.

Aliases are frozen within a batch; those that fuzzy matches teach are returned, to be added before the next.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import refdata as R
from ..functions import text as T
from ..functions import vectors as V
from ..providers import Provider, embedded, picked

#: Known phrases that one task compares keys with, and keys in one group.
PHRASES_A_TASK, KEYS_A_TASK = 20_000, 5_000
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "


def aliases(spark: SparkSession) -> DataFrame:
    """(phrase, relation, place): the phrases, then each relation's own name in words. A constant of some 100 rows."""
    rows = [(p, r) for p, r in R.ALIASES] + [(r.lower().replace("_", " "), r) for r in R.BEHAVIOR]
    return spark.createDataFrame([(p, r, k) for k, (p, r) in enumerate(rows)], "phrase string, relation string, place int")


def match_exact(phrases: DataFrame, known: DataFrame, col: str = "phrase") -> DataFrame:
    """phrases with relation, score 1 and tier confirmed where the key is a phrase or a relation's name."""
    first = known.groupBy(F.col("phrase").alias("__key")).agg(F.min_by("relation", "place").alias("relation"))
    return phrases.withColumn("__key", T.alias_key(F.col(col))).join(F.broadcast(first), "__key", "left").drop("__key")


def _letters(x: list[str]) -> np.ndarray:
    """How often each letter of a key occurs."""
    out = np.zeros((len(x), len(LETTERS)), np.int16)
    for i, own in enumerate(x):
        for c, n in Counter(own).items():
            if (k := LETTERS.find(c)) >= 0:
                out[i, k] = n
    return out


def _best_phrases(known: pd.DataFrame, keys: list[str]) -> list[tuple[str, str, float, int]]:
    """(key, relation, score, place) of each key's best phrase, the first of equals.

    No two strings share more letters in order than out of order: phrases whose letters can't reach the best score so far are left out.
    """
    known = known.sort_values("place")
    phrases, relations, places = known["phrase"].tolist(), known["relation"].tolist(), known["place"].tolist()
    letters, sizes, out = _letters(phrases), np.array([len(p) for p in phrases]), []
    for key in keys:
        most = 2 * np.minimum(letters, _letters([key])).sum(axis=1) / np.maximum(1, sizes + len(key))
        best = (-1.0, 0, 0)
        for i in np.argsort(-most, kind="stable").tolist():
            if round(float(most[i]), 3) < best[0]:
                break
            best = max(best, (round(T.similarity(key, phrases[i]), 3), -places[i], i))
        out.append((key, relations[best[2]], best[0], places[best[2]]))
    return out


def match_fuzzy(phrases: DataFrame, known: DataFrame, col: str = "phrase") -> DataFrame:
    """The best known phrase of each distinct key, the first of equals: (key, relation, score).

    Keys meet the known phrases by groups of both, of bounded size however many there are.
    """
    keys = phrases.select(T.alias_key(F.col(col)).alias("key")).where("key <> ''").distinct()
    shards = -(-known.count() // PHRASES_A_TASK)
    if not shards:
        return keys.select("key", F.lit(None).cast("string").alias("relation"), F.lit(0.0).alias("score"))
    groups = max(1, -(-keys.count() // KEYS_A_TASK))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = known.select("phrase", "relation", "place", F.pmod(F.xxhash64("phrase"), F.lit(shards)).cast("int").alias("shard")).withColumn("group", upto(groups))
    b = keys.select("key", F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int").alias("group")).withColumn("shard", upto(shards))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = _best_phrases(left, right["key"].tolist()) if len(left) else []
        return pd.DataFrame(rows, columns=["key", "relation", "score", "place"])

    each = a.groupBy("shard", "group").cogroup(b.groupBy("shard", "group")).applyInPandas(run, "key string, relation string, score double, place int")
    best = F.max(F.struct(F.col("score"), (-F.col("place")).alias("p"), F.col("relation")))
    return each.groupBy("key").agg(best.alias("b")).select("key", F.col("b.relation").alias("relation"), F.col("b.score").alias("score"))


def normalize(phrases: DataFrame, known: DataFrame, col: str = "phrase", threshold: float = R.FUZZY_THRESHOLD) -> DataFrame:
    """phrases with relation, match_score, tier (confirmed, fuzzy, unknown, reject) and behavior."""
    keyed = phrases.withColumn("__key", T.alias_key(F.col(col)))
    exact = match_exact(phrases.select(F.col(col).alias("phrase")).distinct(), known).where("relation IS NOT NULL").select(T.alias_key(F.col("phrase")).alias("__key"), F.col("relation").alias("exact")).distinct()
    open_ = keyed.join(exact, "__key", "left")
    fuzzy = match_fuzzy(open_.where("exact IS NULL"), known, col).select(F.col("key").alias("__key"), F.col("relation").alias("like"), "score")
    out = open_.join(fuzzy, "__key", "left")
    is_fuzzy = F.col("score") >= threshold
    tier = F.when(F.col("__key") == "", "reject").when(F.col("exact").isNotNull(), "confirmed").when(is_fuzzy, "fuzzy").otherwise("unknown")
    relation = F.when(F.col("__key") == "", "").when(F.col("exact").isNotNull(), F.col("exact")).when(is_fuzzy, F.col("like")).otherwise(T.canonical_token(F.col(col)))
    match = F.when(F.col("exact").isNotNull(), 1.0).otherwise(F.coalesce("score", F.lit(0.0)))
    out = out.withColumns({"relation": relation, "match_score": match, "tier": tier}).withColumn("behavior", T.behavior(F.col("relation")))
    rejected = F.col("relation").isin(*R.BLACKLIST)
    return out.withColumn("tier", F.when(rejected, "reject").otherwise(F.col("tier"))).drop("__key", "exact", "like", "score")


def learned(normalized: DataFrame, known: DataFrame, col: str = "phrase") -> DataFrame:
    """known with the phrases that were matched fuzzily."""
    new = normalized.where("tier = 'fuzzy'").select(T.alias_key(F.col(col)).alias("phrase"), "relation").distinct()
    after = F.lit(1 << 30) + F.pmod(F.xxhash64("phrase"), F.lit(1 << 30))  # behind the seeds, in an order without a global sort
    return known.unionByName(new.withColumn("place", after.cast("int")))


def learn(known: DataFrame, new: DataFrame) -> DataFrame:
    """known with aliases told outright (alias, relation), which take the place of equal ones; blank ones are left out."""
    told = new.select(T.alias_key(F.col("alias")).alias("phrase"), F.upper("relation").alias("relation")).where("phrase <> '' AND relation <> ''")
    told = told.groupBy("phrase").agg(F.max("relation").alias("relation")).withColumn("place", F.lit(-1))
    return known.join(told.select("phrase"), "phrase", "left_anti").select("phrase", "relation", "place").unionByName(told)


def match_meaning(phrases: DataFrame, described: list[tuple[str, list[float]]], threshold: float = R.SEMANTIC_THRESHOLD) -> DataFrame:
    """phrases (with vector) and their nearest described relation at or over the threshold, the first of equals."""
    scored = F.array(*(F.struct(F.round(V.cosine(F.col("vector"), V.literal(v)), 9).alias("score"), F.lit(-k).alias("p"), F.lit(r).alias("relation")) for k, (r, v) in enumerate(described)))
    best = phrases.withColumn("__b", F.array_max(scored))
    return best.withColumns({"relation": F.when(F.col("__b.score") >= threshold, F.col("__b.relation")), "match_score": F.round(F.col("__b.score"), 3)}).drop("__b")


def by_meaning(normalized: DataFrame, provider: Provider, col: str = "phrase") -> DataFrame:
    """normalized phrases, those that no alias matched by meaning, or else by the model's pick; the rest stay unknown."""
    raw = T.strip(F.col(col))
    unmatched = (F.col("tier") == "unknown") | ((F.col("tier") == "reject") & (F.col("match_score") < R.FUZZY_THRESHOLD))
    phrases = normalized.where(unmatched).select(raw.alias("__raw")).where("__raw <> ''").distinct()
    vectors = embedded(phrases.withColumn("__words", F.replace("__raw", F.lit("_"), F.lit(" "))), provider, "__words")
    found = match_meaning(vectors, [(r, provider.embed(d)) for r, d in R.DESCRIPTIONS.items()])
    pick = found.where("relation IS NULL").select("__raw", picked(F.col("__raw"), provider).alias("__pick"))
    found = found.join(pick, "__raw", "left").select("__raw", F.coalesce("relation", "__pick").alias("__found"), F.col("match_score").alias("__score")).where("__found IS NOT NULL")
    out = normalized.withColumn("__raw", F.when(unmatched, raw)).join(found, "__raw", "left")
    hit = F.col("__found").isNotNull()
    out = out.withColumns({"relation": F.coalesce("__found", "relation"), "match_score": F.coalesce("__score", "match_score"), "tier": F.when(hit, "confirmed").otherwise(F.col("tier"))})
    return out.withColumn("behavior", T.behavior(F.col("relation"))).drop("__raw", "__found", "__score")


def unknown_statistics(sightings: DataFrame) -> DataFrame:
    """relation, count and mean confidence; combines by sums."""
    return sightings.groupBy("relation").agg(F.count("*").alias("count"), F.avg("confidence").alias("avg_confidence"))


def combine_unknown(stored: DataFrame, new: DataFrame) -> DataFrame:
    both = stored.select("relation", "count", "avg_confidence").unionByName(unknown_statistics(new))
    return both.groupBy("relation").agg(F.sum("count").alias("count"), (F.sum(F.col("avg_confidence") * F.col("count")) / F.sum("count")).alias("avg_confidence"))


def pending(stored: DataFrame, promoted: DataFrame) -> DataFrame:
    """Unknown relations still in the queue: those seen, but for the promoted ones."""
    return stored.join(promoted.select("relation"), "relation", "left_anti")


def promotions(sightings: DataFrame, order: list[str], count: int = R.PROMOTE_COUNT, confidence: float = R.PROMOTE_CONFIDENCE) -> DataFrame:
    """The first sighting of each relation by which it was seen often and surely enough."""
    c = F.least(F.greatest(F.col("confidence"), F.lit(0.0)), F.lit(1.0))
    so_far = Window.partitionBy("relation").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = sightings.withColumns({"count": F.count("*").over(so_far), "mean": F.avg(c).over(so_far)}).where((F.col("count") >= count) & (F.round("mean", 9) >= confidence))
    first = F.row_number().over(Window.partitionBy("relation").orderBy("count"))
    return seen.withColumn("__n", first).where("__n = 1").select("relation", "count", F.col("mean").alias("avg_confidence"))
