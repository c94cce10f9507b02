"""Append and upsert over Parquet directories; a snapshot in use is never overwritten."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Rows of both, of each key the last by time; at equal times the new row."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(at), F.desc("__new")))
    return both.withColumn("__n", last).where("__n = 1").drop("__n", "__new")


def delete(stored: DataFrame, keys: DataFrame) -> DataFrame:
    return stored.join(keys, keys.columns, "left_anti")


def _pointers(spark: SparkSession, root: str):
    """The folder of pointers and the numbers in it, largest last."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/current")
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(place)] if files.exists(place) else []
    return files, place, sorted(int(n) for n in names if n.isdigit())


def write_snapshot(df: DataFrame, root: str) -> str:
    """Write df as the newest snapshot below root; a pointer, the next number, names it once it is whole.

    Of two writers the later fails to make its pointer, and may write again over what the other left.
    """
    spark = df.sparkSession
    path = f"{root}/snapshot-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, place, numbers = _pointers(spark, root)
    out = files.create(spark._jvm.org.apache.hadoop.fs.Path(place, str(numbers[-1] + 1 if numbers else 0)), False)
    out.write(bytearray(path.encode()))
    out.close()
    return path


def read_snapshot(spark: SparkSession, root: str) -> DataFrame | None:
    """The newest snapshot; none before the first."""
    _, _, numbers = _pointers(spark, root)
    if not numbers:
        return None
    return spark.read.parquet(spark.read.text(f"{root}/current/{numbers[-1]}").head()["value"])
