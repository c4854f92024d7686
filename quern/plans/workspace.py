"""Where tables are written that a plan reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def workspace(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Where that is unset, a temporary one of this machine
    if all executors are on it; on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quern-workspace-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def write_table(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df, written once and read back."""
    path = f"{workspace(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores. A table of few row groups would else be read,
    and its texts split into words, by few tasks; a large one has many, and isn't shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
