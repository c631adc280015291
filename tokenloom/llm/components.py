"""Connected components over an edge table, by alternating large-star and small-star steps.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014).  Every round is one staged
table, so no round depends on the memory of an executor, and no edge or label reaches the driver:
only two numbers per round do, which tell whether the edges still change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import keep_last, stage, staged_paths


def _fewest(edges: DataFrame) -> DataFrame:
    """Per node u the smallest v beside it.  Staged: its join then deals out both sides anew, and Spark can split a hub."""
    return stage(edges.groupBy("u").agg(F.min("v").alias("m")), "cc-min")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _fewest(both)
    joined = both.join(least, "u").where("v > u")
    return joined.select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    joined = edges.join(_fewest(edges), "u")
    return joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges (u long, v long) -> (node, root): for every node on an edge the smallest node it reaches.

    Self loops and repeated edges are ignored, rows with a null end are dropped, and no edges give no rows.
    Roots have a row of their own.
    """
    spark, since = edges.sparkSession, len(staged_paths())
    edges = edges.select("u", "v").where("u <> v")
    edges = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    before = _state(edges)
    while before[0]:
        edges = stage(_small_star(stage(_large_star(edges), "cc-large")), "cc")
        keep_last(spark, since)
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
