"""Validity intervals: what is active, when an edge closes, history and retention.

Rows are never removed but by retention; closing sets the end of validity and the time of retraction together.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import refdata as R

OPEN = "invalid_at IS NULL"
ACTIVE = "invalid_at IS NULL AND retracted_at IS NULL"


def now_literal(now: dt.datetime) -> Column:
    return F.lit(now).cast("timestamp_ntz")


def safe_end(valid_at: Column, end: Column) -> Column:
    """An end of validity at least a millisecond after the start."""
    return F.greatest(end, valid_at + F.expr("INTERVAL '0.001' SECOND"))


def active(edges: DataFrame) -> DataFrame:
    return edges.where(ACTIVE)


def list_active(edges: DataFrame, limit: int = R.RETRIEVE_LIMIT, valid_only: bool = True, confirmed_only: bool = True) -> DataFrame:
    """The newest memories, without transitions."""
    out = active(edges) if valid_only else edges
    if confirmed_only:
        out = out.where("review_status = 'confirmed'")
    out = out.where(~F.col("relation").isin(*R.TRANSITIONS)).orderBy(F.desc("valid_at"), "edge_id").limit(limit)
    return out.select("edge_id", F.col("fact_string").alias("fact"), "confidence", "valid_at", F.col("invalid_at").alias("valid_until"), "retracted_at", "episode_id", F.lit(1.0).alias("score"))


def close(edges: DataFrame, closures: DataFrame, now: dt.datetime) -> DataFrame:
    """Close the edges that closures (edge_id, close_at) names; the earliest time counts."""
    ends = closures.groupBy("edge_id").agg(F.min("close_at").alias("close_at"))
    hit = F.col("close_at").isNotNull()
    return edges.join(ends, "edge_id", "left").withColumns(
        {"invalid_at": F.when(hit, safe_end(F.col("valid_at"), F.col("close_at"))).otherwise(F.col("invalid_at")), "retracted_at": F.when(hit, now_literal(now)).otherwise(F.col("retracted_at"))}
    ).drop("close_at")


def retract(edges: DataFrame, ids: list, now: dt.datetime) -> DataFrame:
    """Close edges by id, again if they are closed."""
    hit = F.col("edge_id").isin(*ids)
    return edges.withColumns(
        {"invalid_at": F.when(hit, safe_end(F.col("valid_at"), now_literal(now))).otherwise(F.col("invalid_at")), "retracted_at": F.when(hit, now_literal(now)).otherwise(F.col("retracted_at"))}
    )


def retain(edges: DataFrame, now: dt.datetime, days: int = R.RETENTION_DAYS) -> DataFrame:
    """All but edges retracted longer ago than so many days; closed edges without a time of retraction stay."""
    return edges.where(F.col("retracted_at").isNull() | (F.col("retracted_at") >= now_literal(now - dt.timedelta(days=days))))


def history(edges: DataFrame, keys: list[str]) -> DataFrame:
    """One slot's chain of values: a repeated value is skipped, and each value closes the one before."""
    order = Window.partitionBy(*keys).orderBy("valid_at", "edge_id")
    fresh = edges.withColumn("__before", F.lag("object").over(order)).where("__before IS NULL OR __before <> object").drop("__before")
    follows = F.lead("valid_at").over(order)
    return fresh.withColumn("invalid_at", F.when(follows.isNotNull(), safe_end(F.col("valid_at"), follows))).withColumn("retracted_at", F.col("invalid_at"))


def as_of(edges: DataFrame, valid: Column, known: Column) -> DataFrame:
    """An extension: the edges that were valid at one time, as they were known at another.

    An edge is known from created_at (valid_at where the table has none) and its end from retracted_at: at an earlier
    time it was still open.
    """
    recorded = F.coalesce("created_at", "valid_at") if "created_at" in edges.columns else F.col("valid_at")
    ended = F.when(F.col("retracted_at").isNull() | (F.col("retracted_at") <= known), F.col("invalid_at"))
    return edges.where((recorded <= known) & (F.col("valid_at") <= valid) & (ended.isNull() | (ended > valid)))
