"""Scratch tables, size checks and row keys shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
import gc
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Serialized bytes up to which a table may be broadcast; beyond it, a shuffle join is used.
BROADCAST_BYTES = 48 << 20
#: Bytes of an Arrow batch: the JVM and the worker each hold a batch more than once.
BATCH_BYTES = 4 << 20


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; a temporary one only where it is unset and Spark is one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="recollect-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def _place(spark: SparkSession, path: str):
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()), own


def materialize(df: DataFrame, *by: str) -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder, in folders by some columns, and read it back.

    The files are replicated as that folder is, so that a lost executor costs no recomputation. They go by ``discard``, or
    when the driver ends.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/recollect/{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    files, own = _place(spark, path)
    files.deleteOnExit(own)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete materialized tables that no later step reads: what was made of them is itself written."""
    for t in tables:
        if path := getattr(t, "_scratch", None):
            files, own = _place(t.sparkSession, path)
            files.delete(own, True)
            files.cancelDeleteOnExit(own)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def row_hashes(*columns: Column) -> list[Column]:
    """Two hashes of 64 bits under different seeds: equal in both only for equal values."""
    return [F.xxhash64(F.lit(seed), *columns) for seed in (11, 23)]


def maybe_broadcast(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast if the counted rows of a materialized table are proven to fit; else leave it to a shuffle join."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def small(df: DataFrame, size: Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Like maybe_broadcast for rows of uneven width; size is a row's bytes."""
    total = df.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).head()["n"]
    return F.broadcast(df) if total <= limit else df


def small_batches(spark: SparkSession, limit: int = BATCH_BYTES) -> None:
    """Bound the session's Arrow batches by bytes; a lower bound stays. By Spark's own they are of 10,000 rows or 64 MB."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > limit:
        spark.conf.set(key, str(limit))


def release() -> None:
    """Give freed memory back: workers are kept for later stages, and would hold the most that any of them used."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run):
    """Wrap a function over a partition's batches: what it used is given back at its end."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))

