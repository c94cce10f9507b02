"""Tables written to the folder that all executors share, so that plans stay short and each text is worked on once."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; a temporary one only where it is unset and Spark is one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="recollect-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def folder(spark: SparkSession) -> str:
    """A new folder's name."""
    return f"{root(spark)}/recollect/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df written as Parquet and read back; the files go when the driver ends."""
    spark = df.sparkSession
    path = folder(spark)
    df.write.parquet(path)
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(own)
    return spark.read.schema(df.schema).parquet(path)
