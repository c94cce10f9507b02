"""From episodes to facts, and from facts to edges and profiles.

Steps that are read several times are written as Parquet to the shared folder, so that plans stay short and a model is
asked once for each text.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import providers as P
from .. import refdata as R
from .. import schema
from ..functions import text as T
from ..operators import conflict, ontology, profile, resolve, routing
from ..operators.temporal import now_literal
from ..scratch import written
from ..sources import snapshots, store


def first_messages(episodes: DataFrame, *more: str) -> DataFrame:
    """The first message of each user's turn, whatever its role: what is extracted from."""
    others = F.struct("pos", "role", "content", *more)
    return episodes.groupBy("user_id").agg(F.min(others).alias("m")).select("user_id", "m.*")


def located_clauses(texts: DataFrame, key: str, text: str, provider: P.Provider) -> DataFrame:
    """(key, ordinal, text, temporal_status, start, end); a clause is sought from the start of the one before."""
    each = texts.select(key, F.col(text).alias("__t"), F.posexplode(T.sentences(F.col(text))).alias("__n", "__s"))
    each = each.withColumn("__raw", P.classified(F.col("__s"), provider))
    each = each.select(key, "__t", "__n", F.posexplode(store.parsed_clauses(F.col("__raw"), F.col("__s"))).alias("__m", "__c")).where("trim(__c.clause) <> ''")
    per = each.groupBy(key, "__t").agg(F.sort_array(F.collect_list(F.struct("__n", "__m", "__c"))).alias("__l"))

    def place(acc, x):
        clause, low = F.trim(x["__c"]["clause"]), F.lower(F.col("__t"))
        exact = F.instr(F.substring(F.col("__t"), acc["at"] + 1, F.length("__t")), clause)
        loose = F.instr(F.substring(low, acc["at"] + 1, F.length("__t")), F.lower(clause))
        whole = F.instr(low, F.lower(clause)) - 1
        start = F.when(exact > 0, acc["at"] + exact - 1).when(loose > 0, acc["at"] + loose - 1).otherwise(whole)
        row = F.struct(clause.alias("text"), F.lower(x["__c"]["status"]).alias("temporal_status"), start.cast("int").alias("start"), F.when(start >= 0, start + F.length(clause)).otherwise(-1).cast("int").alias("end"))
        return F.struct(F.greatest(start, acc["at"]).cast("int").alias("at"), F.concat(acc["out"], F.array(row)).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text:string,temporal_status:string,start:int,end:int>>").alias("out"))
    rows = per.select(key, F.posexplode(F.aggregate("__l", zero, place, lambda acc: acc["out"])).alias("ordinal", "c"))
    return rows.select(key, "ordinal", "c.*")


def candidate_facts(episodes: DataFrame, provider: P.Provider) -> DataFrame:
    """Facts of the local extractor and, for episodes with a doubtful candidate or none, of the model.

    Local: pairs with both sides, the lesser confidence, the first of equal ones. The model's: all but those to discard.
    hint names a category that the model found listed in full.
    """
    low = lambda c: F.round(T.pair_confidence(c["head_confidence"], c["tail_confidence"]), 3) < R.HIGH_CONFIDENCE
    whole = F.filter("candidates", lambda c: (F.trim(c["head"]) != "") & (F.trim(c["tail"]) != ""))
    needed = (T.strip(F.col("content")) != "") & ((F.size(whole) <= 0) | F.exists(whole, low))
    own = P.structured(P.extracted(episodes, provider), provider, needed)
    own = own.withColumn("hint", F.array_max(F.transform("structured", lambda x: x["retract_category"])))
    own = written(own.select("episode_id", "user_id", "content", "hint", "candidates", "structured"))
    found = own.select("episode_id", "user_id", "content", "hint", F.posexplode("candidates").alias("ordinal", "c"))
    found = found.where("trim(c.head) <> '' AND trim(c.tail) <> ''")
    local = found.select(
        "episode_id", "user_id", "content", "hint", "ordinal", T.subject(F.col("c.head")).alias("subject"), F.col("c.label").alias("relation_raw"),
        T.trim_object(F.col("c.tail")).alias("object"), F.round(T.pair_confidence(F.col("c.head_confidence"), F.col("c.tail_confidence")), 3).alias("confidence"),
        F.col("c.span").alias("source_span"), F.lit("local").alias("source"), F.lit("unspecified").alias("temporal_status"), F.lit(False).alias("retraction_signal"),
    )
    told = own.select("episode_id", "user_id", "content", "hint", F.size("candidates").alias("__after"), F.posexplode("structured").alias("__n", "m"))
    told = told.where("trim(m.relation) <> '' AND trim(m.object) <> ''")
    model = told.select(
        "episode_id", "user_id", "content", "hint", (F.col("__after") + F.col("__n")).alias("ordinal"), T.subject(F.coalesce("m.subject", F.lit("user"))).alias("subject"),
        F.col("m.relation").alias("relation_raw"), T.trim_object(F.col("m.object")).alias("object"), F.coalesce("m.confidence", F.lit(1.0)).alias("confidence"),
        F.col("m.source_span").alias("source_span"), F.lit("llm").alias("source"),
        F.coalesce(F.lower("m.temporal_status"), F.lit("unspecified")).alias("temporal_status"), F.coalesce("m.retraction_signal", F.lit(False)).alias("retraction_signal"),
    )
    model = model.where(routing.judge(F.col("confidence")) != "discard")
    return written(routing.prefer_model(local.unionByName(model)))


def extract_facts(episodes: DataFrame, provider: P.Provider) -> DataFrame:
    """Normalized facts with spans, tense and signals, and the content they come from; rejected and unknown relations go.

    A phrase that no alias matches is sought by meaning, then picked by the model. retract_category names the category
    that the episode lists in full, if any.
    """
    facts = candidate_facts(episodes, provider)
    known = ontology.aliases(episodes.sparkSession)
    named = ontology.by_meaning(written(ontology.normalize(facts, known, "relation_raw")), provider, "relation_raw").where("tier IN ('confirmed', 'fuzzy')")
    named = named.withColumn("relation", routing.pet_relation(F.col("relation"), F.col("source_span"))).withColumn("review_status", routing.review_status(F.col("tier")))
    named = routing.merge(named, ["episode_id"]).withColumn("ordinal", F.col("position")).drop("position")
    named = named.withColumns({
        "fact_string": T.fact_string(F.col("subject"), F.col("relation"), F.col("object")),
        "source_span": routing.inferred_span(F.col("content"), F.col("source_span"), F.col("object")),
    })
    named = written(named)
    clauses = located_clauses(episodes, "episode_id", "content", provider)
    at = F.instr(F.lower("content"), F.lower("source_span")) - 1
    spans = named.select("episode_id", F.col("ordinal").alias("fact"), F.col("source_span").alias("span"), at.alias("start"), (at + F.length("source_span")).alias("end"))
    status = routing.clause_status(spans, clauses, ["episode_id"]).select("episode_id", F.col("fact").alias("ordinal"), F.col("temporal_status").alias("__found"))
    timed = routing.with_temporal(named.join(status, ["episode_id", "ordinal"], "left"), F.coalesce("__found", F.lit("unspecified"))).drop("__found")
    signal = routing.retraction_signal(F.col("content"), F.col("relation"), F.col("object"), F.col("temporal_status"), F.col("retraction_signal"))
    timed = timed.withColumn("retraction_signal", signal)
    uses = F.bool_or((F.upper("relation") == "USES") & ~F.col("retraction_signal")).over(Window.partitionBy("episode_id"))
    timed = timed.withColumn("__uses", uses)
    return written(timed.withColumn("retract_category", routing.category_signal(F.col("content"), F.col("__uses"), F.col("hint"))).drop("__uses", "hint"))


def storable(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts to store, deduplicated within each episode, and facts for review with their reasons."""
    gated = routing.gate(facts)
    review = gated.where(~F.col("route").isin("store", "drop")).withColumnRenamed("route", "rejection_reason")
    return routing.dedupe_batch(gated.where("route = 'store'").drop("route"), ["episode_id"], "content"), review


def ingest(
    episodes: DataFrame, provider: P.Provider, now: dt.datetime, stored: DataFrame | None = None, profiles: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges, facts for review, and profiles of a batch of episodes (episode_id, user_id, content) in the order of their ids.

    stored are the edges, and profiles the profiles, that earlier batches left; the edges returned hold the stored ones.
    """
    kept, review = storable(extract_facts(episodes, provider))
    facts = kept.select(
        F.sha2(F.concat_ws("\u0001", "episode_id", "subject", "relation", "object"), 256).alias("edge_id"), "user_id", "subject", "relation", "object", "fact_string",
        now_literal(now).alias("valid_at"), F.col("position").alias("ordinal"), F.col("retraction_signal").alias("retraction"), "confidence", "review_status", "episode_id", "retract_category",
    )
    facts = written(facts)
    about = facts.select("edge_id", "subject", "fact_string", "confidence", "review_status", "episode_id")
    if stored is not None:
        about = stored.select(*about.columns).unionByName(about.join(stored.select("edge_id"), "edge_id", "left_anti"))
    edges = written(resolve.resolve(facts, provider, stored).join(about, "edge_id"))
    edges = written(conflict.reconciled(edges, now))
    return edges, review, profile.sync(edges, profiles)


def ingest_turn(messages: DataFrame, root: str, provider: P.Provider, now: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """Store a turn's messages (user_id, session_id, pos, role, content, created_at, metadata) and what its first messages tell.

    Episodes are appended below root; edges and profiles are its newest snapshots, which the turn reads and follows.
    Returns the edges and the facts for review.
    """
    spark = messages.sparkSession
    store.store_turn(messages, f"{root}/episodes")
    rows = store.turn_rows(messages)
    texts = first_messages(rows.withColumnRenamed("id", "episode_id"), "episode_id").select("episode_id", F.col("user_id").cast("string").alias("user_id"), "content")
    stored, profiles = (snapshots.read_snapshot(spark, f"{root}/{kind}") for kind in ("edges", "profiles"))
    edges, review, profiles = ingest(texts, provider, now, stored and stored.withColumnRenamed("id", "edge_id"), profiles)
    edges = store.conformed(edges.withColumnRenamed("edge_id", "id"), schema.EDGES)
    snapshots.write_snapshot(edges, f"{root}/edges")
    snapshots.write_snapshot(store.conformed(profiles, schema.PROFILE), f"{root}/profiles")
    return snapshots.read_snapshot(spark, f"{root}/edges"), review


__all__ = ["candidate_facts", "extract_facts", "first_messages", "ingest", "ingest_turn", "located_clauses", "storable"]
