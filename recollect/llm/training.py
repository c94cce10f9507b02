"""Bounded samples of labelled documents, and folds by the checksum of the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, folds: int) -> Column:
    """CRC-32 of the id as text, modulo folds; null ids belong to none."""
    return F.crc32(F.col(id_col).cast("string")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, keep: Column, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """(text, label) of at most per_class documents a class, chosen by the id's hash, equal texts once; and the classes' sizes.

    keep says which labels may be learnt from. Of an id with several labels, and of equal texts with several, the smallest
    counts; labels but 0 and 1 don't.
    """
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("id").isNotNull() & keep)
    own = own.groupBy("id").agg(F.min("label").alias("label"))
    sizes = {r["label"]: r["count"] for r in own.groupBy("label").count().collect()}
    some = [own.where(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(per_class) for c in (0, 1)]
    chosen = F.broadcast(some[0].unionByName(some[1]))  # at most twice per_class rows
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(chosen, "id")
    return found.groupBy("text").agg(F.min("label").alias("label")), sizes
