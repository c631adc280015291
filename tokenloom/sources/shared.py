"""The folder that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  Where that is unset, a session on this machine alone gets a folder of it; on a cluster that is an error."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir: set it to a folder that all executors see")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tokenloom-"))
        base = context.getCheckpointDir()
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/tokenloom/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, if its scan has fewer: a small file of few row groups would keep most idle.

    Tables of more partitions, all large ones, stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
