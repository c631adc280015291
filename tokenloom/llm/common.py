"""What the operators share: the folder all executors see, staged tables and text columns."""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.sources.shared import fresh_path, shared_dir  # noqa: F401

#: Characters that separate words in every operator that speaks of `[^\x20\x09-\x0D]+`.
WORD = r"[^\x20\x09-\x0D]+"


_LOCAL = threading.local()


def staged_paths() -> list[str]:
    """The tables that this thread has staged and not yet deleted, the oldest first."""
    if not hasattr(_LOCAL, "paths"):
        _LOCAL.paths = []
    return _LOCAL.paths


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    This cuts the lineage, so a lost executor costs a re-read of files and not the work before it, and
    what reads the table plans with its true size (broadcast or not, skewed partitions split).  It stays until
    `keep_last` or `release` deletes it.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    staged_paths().append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for text in paths:
        path = jvm.org.apache.hadoop.fs.Path(text)
        path.getFileSystem(conf).delete(path, True)


def keep_last(spark: SparkSession, since: int) -> None:
    """Delete the tables that this thread has staged since there were `since` of them, but for the last, which has taken all in."""
    paths = staged_paths()
    _delete(spark, paths[since:-1])
    paths[since:-1] = []


def release(spark: SparkSession) -> None:
    """Delete every table that this thread has staged.  For callers who have written their results; what reads such a table can't be read after."""
    _delete(spark, staged_paths())
    staged_paths().clear()


def whole_text(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def in_place(condition: Column) -> Column:
    """The condition as a column that a filter on it leaves where it is.

    A filter on computed columns is pushed below them by spelling them out; where lambdas read those columns,
    a text would be taken apart again for each element.  Ids count from 0 on, so the value is unchanged.
    """
    return condition & (F.monotonically_increasing_id() >= 0)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
