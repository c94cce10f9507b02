"""Ingestion as a stream: files of facts in, the edges that each micro-batch stores or closes out."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import resolve
from ..providers import Offline, Provider

FACTS = "edge_id string, user_id string, relation string, object string, valid_at timestamp_ntz, ordinal long, retraction boolean"


def fact_stream(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(FACTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _step(provider: Provider | None):
    """Fold a user's new facts after the open edges that are the user's state; rows are the edges stored or closed."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else []
        rows = resolve.ordered(pd.concat(list(parts)))
        before = [{"edge_id": i, "user_id": key[0], "relation": r, "object": o, "fact_string": said, "valid_at": pd.Timestamp(at), "stored": True, "invalid_at": None, "retracted_at": None, "episode_id": None} for i, r, o, said, at in held]
        edges = resolve.fold(before + rows, provider)
        was_open = {e["edge_id"] for e in before}
        state.update((json.dumps([(e["edge_id"], e["relation"], e["object"], e["said"], e["valid_at"].isoformat()) for e in edges if e["invalid_at"] is None]),))
        changed = [e for e in edges if e["edge_id"] not in was_open or e["invalid_at"] is not None]
        yield resolve.frame(changed)

    return run


def ingest_stream(facts: DataFrame, root: str, checkpoint: str, provider: Provider | None = Offline()) -> StreamingQuery:  # noqa: B008
    """Write what each batch changes below root under its number; the open edges of each user are the stream's state.

    A batch costs its own facts and the open edges of its users, however long the stream has run. A batch that runs again
    overwrites its own part, so that a restart stores nothing twice.
    """

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/part={number}")

    changes = resolve.rows(facts, False).groupBy("user_id").applyInPandasWithState(_step(provider), resolve.RESULT, "open string", "update", GroupStateTimeout.NoTimeout)
    return changes.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_edges(spark: SparkSession, root: str) -> DataFrame:
    """Every edge as the batches so far left it: closed where one of them closed it."""
    parts = spark.read.option("basePath", root).parquet(f"{root}/part=*")
    return parts.groupBy("edge_id", "user_id", "relation", "object", "valid_at").agg(F.max("invalid_at").alias("invalid_at"), F.max("retracted_at").alias("retracted_at"))


def event_windows(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """An extension: counts of each type in event-time windows with a watermark; works on streams and on tables."""
    own = events.withWatermark("ts", late) if events.isStreaming else events
    return own.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
