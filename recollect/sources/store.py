"""Episodes and edges as stored: appends, lookups and scans. Every filter reaches the Parquet scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..schema import EPISODES
from .snapshots import append


def turn_rows(messages: DataFrame) -> DataFrame:
    """Episodes of messages (user_id, session_id, pos, role, content, created_at, metadata), with ids by their natural key."""
    key = F.concat_ws("\u0001", F.col("user_id").cast("string"), F.coalesce(F.col("session_id").cast("string"), F.lit("")), F.col("pos").cast("string"))
    return messages.withColumn("id", F.sha2(key, 256))


def store_turn(messages: DataFrame, path: str) -> DataFrame:
    """Append all messages; return the first id of each user's turn."""
    rows = turn_rows(messages)
    append(conformed(rows, EPISODES), path)
    return first_ids(rows)


def first_ids(rows: DataFrame) -> DataFrame:
    return rows.groupBy("user_id").agg(F.min_by("id", "pos").alias("id"))


def episode(episodes: DataFrame, key) -> DataFrame:
    return episodes.where(F.col("id") == key)


def conformed(df: DataFrame, schema: str) -> DataFrame:
    """df with the columns of a schema, in its order and types; those that it lacks are null."""
    kinds = [c.strip().split(" ") for c in schema.split(",")]
    return df.select(*((F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name) for name, kind in kinds))


def open_edges(edges: DataFrame, user=None, subject: str | None = None, relation: str | None = None) -> DataFrame:
    """Open edges, of a user, and of one subject and relation."""
    out = edges.where("invalid_at IS NULL")
    for column, value in (("user_id", user), ("subject", subject), ("relation", relation)):
        if value is not None:
            out = out.where(F.col(column) == value)
    return out


def retracted_at(metadata: Column) -> Column:
    """The time of retraction that imported rows carry in their JSON."""
    return T.timestamp(F.get_json_object(metadata, "$.retracted_at"))


PAIRS = "map<string,array<struct<head:struct<text:string,confidence:double>,tail:struct<text:string,confidence:double>>>>"


def flattened_pairs(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """An extractor's answer, JSON of labels to pairs, as rows; pairs with a blank side go."""
    rows = df.select(*keys, F.explode(F.from_json(column, PAIRS)).alias("label", "pairs")).select(*keys, "label", F.posexplode("pairs").alias("ordinal", "p"))
    rows = rows.select(*keys, "label", "ordinal", T.strip(F.col("p.head.text")).alias("head"), T.strip(F.col("p.tail.text")).alias("tail"), T.pair_confidence(F.col("p.head.confidence"), F.col("p.tail.confidence")).alias("confidence"))
    return rows.where("head <> '' AND tail <> ''")


CLAUSES = "array<struct<clause:string,status:string>>"


def parsed_clauses(raw: Column, sentence: Column) -> Column:
    """A classifier's answer, code fences aside; unless all of it is well formed, the sentence as one unspecified clause."""
    plain = F.regexp_replace(raw, r"(?i)^\s*```(?:json)?\s*|\s*```\s*$", "")
    found = F.when(plain.rlike(r"^\s*\["), F.from_json(plain, CLAUSES))
    good = (F.size(found) > 0) & F.forall(found, lambda c: c["clause"].isNotNull() & F.coalesce(c["status"].isin("PAST", "CURRENT", "FUTURE", "UNSPECIFIED"), F.lit(False)))
    whole = F.array(F.struct(sentence.alias("clause"), F.lit("UNSPECIFIED").alias("status")))
    return F.when(good, found).otherwise(whole)
