"""A user's profile from open edges about the user."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import refdata as R
from ..functions import text as T
from .temporal import OPEN


def newest(edges: DataFrame, keys: list[str]) -> DataFrame:
    """The newest edge of each key; an aggregate, not a window, so that partial results are combined before the shuffle."""
    others = [c for c in edges.columns if c not in keys]
    first = F.min(F.struct((-F.unix_micros(F.col("valid_at").cast("timestamp"))).alias("t"), F.col("edge_id").alias("i"), F.struct(*others).alias("row")))
    return edges.groupBy(*keys).agg(first.alias("f")).select(*keys, *(F.col(f"f.row.{c}").alias(c) for c in others))


def values(edges: DataFrame) -> DataFrame:
    """user_id, key, value (a string), value_type: all keys but the stack."""
    own = edges.where(OPEN).where("subject = 'user'").withColumn("key", T.lookup(F.col("relation"), R.PROFILE_KEYS)).where("key IS NOT NULL")
    single = newest(own.where(F.col("key").isin("role", "company") | F.col("relation").isin(*R.SINGULAR)), ["user_id", "key"])
    single = single.select("user_id", "key", T.profile_value(F.col("relation"), F.col("object")).alias("value"), F.lit("string").alias("value_type"), F.col("valid_at").alias("updated_at"))
    many = own.where(~F.col("key").isin("role", "company") & ~F.col("relation").isin(*R.SINGULAR)).withColumn("v", T.profile_value(F.col("relation"), F.col("object")))
    return single.where("value IS NOT NULL").unionByName(lists(many))


def lists(rows: DataFrame) -> DataFrame:
    """Distinct values (v) of each user and key, newest first, as JSON; letters' case aside, the newest spelling counts."""
    order = Window.partitionBy("user_id", "key", F.lower("v")).orderBy(F.desc("valid_at"), "edge_id")
    once = rows.where("v IS NOT NULL").withColumn("__n", F.row_number().over(order)).where("__n = 1")
    each = F.struct((-F.unix_micros(F.col("valid_at").cast("timestamp"))).alias("t"), F.col("edge_id").alias("i"), F.col("v"))
    out = once.groupBy("user_id", "key").agg(F.sort_array(F.collect_list(each)).alias("l"), F.max("valid_at").alias("updated_at"))
    return out.select("user_id", "key", F.to_json(F.transform("l", lambda x: x["v"])).alias("value"), F.lit("list").alias("value_type"), "updated_at")


def stack(edges: DataFrame) -> DataFrame:
    uses = edges.where(OPEN).where("subject = 'user' AND relation = 'USES'").where(T.is_technology(F.col("object")))
    return lists(uses.withColumns({"key": F.lit("current_stack"), "v": T.strip(F.col("object"))}))


def sync(edges: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """The profile that open edges give. A stored role stays where the newest one is unfit; other keys without a value go."""
    new = values(edges).unionByName(stack(edges))
    if stored is None:
        return new
    roles = edges.where(OPEN).where(F.col("relation").isin("IS", "HAS_ROLE") & (F.col("subject") == "user")).select("user_id").distinct()
    kept = stored.where("key = 'role'").join(roles, "user_id", "left_semi").join(new.select("user_id", "key"), ["user_id", "key"], "left_anti")
    return new.unionByName(kept)


def read(profile: DataFrame) -> DataFrame:
    """A map a user, its last update, and typed views: lists from JSON, numbers where they parse."""
    entry = F.struct("key", "value")
    return profile.groupBy("user_id").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("profile"), F.max("updated_at").alias("last_updated"))


def decoded(profile: DataFrame) -> DataFrame:
    return profile.withColumns({
        "list": F.when(F.col("value_type") == "list", F.from_json("value", "array<string>")),
        "number": F.when(F.col("value_type") == "number", F.col("value").try_cast("double")),
    })
