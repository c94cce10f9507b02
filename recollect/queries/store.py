"""Stored tables and small lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import refdata as R
from ..functions import text as T
from ..sources import store
from ..sources import tables as S
from ..sources.tables import EDGES_SQL


def _messages(spark, sf_dir):
    e = S.episodes(spark, sf_dir)
    return e.select("user_id", F.lit(None).cast("string").alias("session_id"), "pos", "role", "content")


def first_episode_ids(spark, sf_dir):
    return store.first_ids(store.turn_rows(_messages(spark, sf_dir)))


def episode_lookup(spark, sf_dir):
    rows = store.turn_rows(_messages(spark, sf_dir))
    key = rows.where("user_id = 3 AND pos = 1").select("id").head()
    return store.episode(rows, key["id"] if key else "").select("user_id", "pos", "role", F.md5("content").alias("content_md5"))


def open_edges_of_user(spark, sf_dir):
    return store.open_edges(S.edges(spark, sf_dir), 8).select("edge_id", "relation", "object")


def edges_by_relation(spark, sf_dir):
    return store.open_edges(S.edges(spark, sf_dir), 8, "user", "USES").select("edge_id", "object", "fact_string")


def retracted_metadata(spark, sf_dir):
    """Times of retraction from JSON; every third is no time."""
    e = S.table(spark, sf_dir, "events")
    time = F.when(F.col("event_id") % 3 == 0, F.lit("never")).otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")))
    meta = F.to_json(F.struct(time.alias("retracted_at")))
    return e.select("event_id", F.unix_micros(store.retracted_at(meta).cast("timestamp")).alias("retracted_at"))


def relation_tables(spark, sf_dir):
    """Slot, family, behaviour, blacklist, priority and profile key of every relation."""
    df = spark.createDataFrame([(r,) for r in R.BEHAVIOR], "relation string")
    c = F.col("relation")
    return df.select(
        "relation", T.slot(c).alias("slot"), T.family(c).alias("family"), T.behavior(c).alias("behavior"), c.isin(*R.BLACKLIST).alias("blacklisted"), c.isin(*R.TRANSITIONS).alias("transition"),
        T.lookup(c, R.STORE_PRIORITY, R.DEFAULT_PRIORITY).alias("priority"), T.lookup(c, R.PROFILE_KEYS).alias("profile_key"), T.supersedes(F.lit("WORKS_AT"), c).alias("below_works_at"),
    )


PAIR_ROWS = (
    (1, '{"works at": [{"head": {"text": " I ", "confidence": 0.9}, "tail": {"text": "Slice", "confidence": 0.6}}, {"head": {"text": ""}, "tail": {"text": "x"}}]}'),
    (2, '{"uses": [{"head": {"text": "Ann"}, "tail": {"text": "Go"}}], "plays": []}'), (3, "{}"), (4, None),
)


def flattened_pairs(spark, sf_dir):
    df = store.flattened_pairs(spark.createDataFrame(list(PAIR_ROWS), "id int, raw string"), "raw", ["id"])
    return df.select("id", "label", T.subject(F.col("head")).alias("subject"), "tail", "confidence")


CLAUSE_ROWS = ((1, '```json\n[{"clause": "I left", "status": "PAST"}]\n```'), (2, "not JSON"), (3, '[{"clause": "x", "status": "MAYBE"}]'), (4, "[]"), (5, None))


def parsed_clauses(spark, sf_dir):
    df = spark.createDataFrame([(*r, "whole") for r in CLAUSE_ROWS], "id int, raw string, sentence string")
    return df.select("id", F.explode(store.parsed_clauses(F.col("raw"), F.col("sentence"))).alias("c")).select("id", "c.*")


def returned_tokens(spark, sf_dir):
    """Tokens of each language's documents, and how many there are."""
    d = S.corpus(spark, sf_dir).select("tenant", T.token_count(F.col("fact_string")).alias("n"))
    return d.groupBy("tenant").agg(F.sum("n").alias("tokens"), F.count("*").alias("memories"))


QUERIES = {f.__name__: f for f in (first_episode_ids, episode_lookup, open_edges_of_user, edges_by_relation, retracted_metadata, relation_tables, flattened_pairs, parsed_clauses, returned_tokens)}


def _case(table: dict) -> str:
    return "CASE relation " + " ".join(f"WHEN '{k}' THEN " + (f"'{v}'" if isinstance(v, str) else str(v)) for k, v in table.items())


ORACLE_SQL = {
    "first_episode_ids": "SELECT conv_id AS user_id, sha256(conv_id || chr(1) || '' || chr(1) || min(turn)) AS id FROM conversations GROUP BY conv_id",
    "episode_lookup": "SELECT conv_id AS user_id, turn AS pos, role, md5(text) AS content_md5 FROM conversations WHERE conv_id = 3 AND turn = 1",
    "open_edges_of_user": "WITH " + EDGES_SQL + " SELECT edge_id, relation, object FROM edges WHERE user_id = 8",
    "edges_by_relation": "WITH " + EDGES_SQL + " SELECT edge_id, object, 'user uses ' || object AS fact_string FROM edges WHERE user_id = 8 AND relation = 'USES'",
    "retracted_metadata": "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN epoch_us(date_trunc('second', ts)) END AS retracted_at FROM events",
    "relation_tables": "SELECT relation, " + _case(R.SLOTS) + " END AS slot, " + _case(R.FAMILIES) + " END AS family, " + _case(R.BEHAVIOR) + " END AS behavior, relation IN ('BORN_IN', 'SWITCHED_FROM', 'SWITCHED_TO') AS blacklisted, "
    "relation IN ('SWITCHED_FROM', 'SWITCHED_TO') AS transition, CAST(" + _case(R.STORE_PRIORITY) + " ELSE 3 END AS INT) AS priority, " + _case(R.PROFILE_KEYS) + " END AS profile_key, relation IN ('WORKED_AT', 'SWITCHED_FROM', 'SWITCHED_TO') AS below_works_at "
    "FROM (VALUES " + ", ".join(f"('{r}')" for r in R.BEHAVIOR) + ") v(relation)",
    "flattened_pairs": "SELECT id, label, subject, tail, CAST(confidence AS DOUBLE) AS confidence FROM (VALUES (1, 'works at', 'user', 'Slice', 0.6), (2, 'uses', 'Ann', 'Go', 0.75)) v(id, label, subject, tail, confidence)",
    "parsed_clauses": "SELECT * FROM (VALUES (1, 'I left', 'PAST'), (2, 'whole', 'UNSPECIFIED'), (3, 'whole', 'UNSPECIFIED'), (4, 'whole', 'UNSPECIFIED'), (5, 'whole', 'UNSPECIFIED')) v(id, clause, status)",
    "returned_tokens": "SELECT lang AS tenant, CAST(sum(greatest(1, length(text) // 4)) AS BIGINT) AS tokens, count(*) AS memories FROM documents GROUP BY lang",
}
