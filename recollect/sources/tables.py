"""The supplied Parquet tables, and the engine's tables derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

EDGE_RELATIONS = {"signup": "LIVES_IN", "purchase": "WORKS_AT", "view": "USES", "click": "PREFERS", "error": "SWITCHED_FROM"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _edges(events: DataFrame, relation, obj) -> DataFrame:
    return events.select(
        F.col("event_id").alias("edge_id"), "user_id", F.lit("user").alias("subject"), relation.alias("relation"), obj.alias("object"),
        F.least(F.col("value") / 100, F.lit(1.0)).alias("confidence"), F.col("event_id").alias("episode_id"), F.lit("confirmed").alias("review_status"),
        F.col("ts").alias("valid_at"), F.lit(None).cast("timestamp_ntz").alias("invalid_at"), F.lit(None).cast("timestamp_ntz").alias("retracted_at"),
    ).withColumn("fact_string", T.fact_string(F.col("subject"), F.col("relation"), F.col("object")))


def _k():
    return F.get_json_object("props", "$.k").cast("int")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An open edge for each event; the relation is the event's type, the object its key."""
    events = table(spark, sf_dir, "events")
    return _edges(events, T.lookup(F.col("event_type"), EDGE_RELATIONS), F.concat(F.lit("o"), _k().cast("string")))


def conflicting_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open edges with few objects and every relation that reconciliation knows."""
    relation = (
        F.when(F.col("event_type") == "signup", F.when(_k() % 2 == 0, "IS").otherwise("HAS_ROLE"))
        .when(F.col("event_type") == "view", "LIVES_IN")
        .when(F.col("event_type") == "click", "BORN_IN")
        .when(F.col("event_type") == "purchase", F.when(F.col("value") < 35, "WORKED_AT").otherwise("WORKS_AT"))
        .otherwise("SWITCHED_TO")
    )
    return _edges(table(spark, sf_dir, "events"), relation, F.concat(F.lit("o"), (_k() % 10).cast("string")))


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("user_id"), F.col("turn").alias("pos"), "role", F.col("text").alias("content"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as facts to search."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("edge_id"), F.col("lang").alias("tenant"), "source", F.col("text").alias("fact_string"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("edge_id"), F.col("label").alias("tenant"), F.col("embedding").cast("array<double>").alias("vector"))


#: The same tables in SQL.
EDGES_SQL = """edges AS (
  SELECT event_id AS edge_id, user_id, CASE event_type WHEN 'signup' THEN 'LIVES_IN' WHEN 'purchase' THEN 'WORKS_AT' WHEN 'view' THEN 'USES' WHEN 'click' THEN 'PREFERS' ELSE 'SWITCHED_FROM' END AS relation,
    'o' || json_extract_string(props, '$.k') AS object, least(value / 100, 1.0) AS confidence, ts AS valid_at, event_type
  FROM events)"""
CONFLICTING_SQL = """edges AS (
  SELECT event_id AS edge_id, user_id, CASE WHEN event_type = 'signup' AND CAST(json_extract_string(props, '$.k') AS INT) % 2 = 0 THEN 'IS' WHEN event_type = 'signup' THEN 'HAS_ROLE'
      WHEN event_type = 'view' THEN 'LIVES_IN' WHEN event_type = 'click' THEN 'BORN_IN' WHEN event_type = 'purchase' AND value < 35 THEN 'WORKED_AT' WHEN event_type = 'purchase' THEN 'WORKS_AT' ELSE 'SWITCHED_TO' END AS relation,
    'o' || CAST(CAST(json_extract_string(props, '$.k') AS INT) % 10 AS VARCHAR) AS object, ts AS valid_at
  FROM events)"""
