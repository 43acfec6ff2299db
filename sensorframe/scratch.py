"""Written tables that pin an intermediate result.

An operator that reads one shuffled layout twice (say, once to count rows per
partition and once to number them) must see the *same* layout both times.
Writing it to the folder shared by the cluster pins it, survives the loss of
executors, and lets the second reader prune columns and lets Catalyst see the
real size of the table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_pinned: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` or ``SparkContext.setCheckpointDir`` names; all executors must share it."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return configured.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/sensorframe/{label}-{uuid.uuid4().hex}"


def pin(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return the written table."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    _pinned.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release_pinned(spark: SparkSession) -> int:
    """Delete the tables this process has pinned; frames built on them end with them."""
    released = 0
    while _pinned:
        path = spark._jvm.org.apache.hadoop.fs.Path(_pinned.pop())
        released += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return released
