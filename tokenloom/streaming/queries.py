"""The streaming parser over the events table, as a query that ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.sources.shared import fresh_path
from tokenloom.streaming.chunks import parse_chunks

#: A group of streams gets about so many chunks, however large the table.
CHUNKS_IN_GROUP = 4096


def chunked_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream_id, n_tokens, n_errors, last_offset) of events.props in chunks of four bytes, a row per event.

    Null props are empty, and an empty text is one chunk of no bytes, which gives an error.
    """
    path = fresh_path(spark, "stream")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events = events.select(F.col("event_id").cast("string").alias("stream_id"), F.encode(F.coalesce("props", F.lit("")), "UTF-8").alias("b"))
    last = F.greatest(F.floor((F.octet_length("b") - 1) / 4), F.lit(0).cast("long"))
    cut = events.select("stream_id", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("seq"), "b", last.alias("last"))
    cut.select("stream_id", "seq", F.substring(F.col("b"), (F.col("seq") * 4 + 1).cast("int"), F.lit(4)).alias("chunk"), (F.col("seq") == F.col("last")).alias("eof")).write.parquet(f"{path}/chunks")
    stream = spark.readStream.schema("stream_id string, seq long, chunk binary, eof boolean").parquet(f"{path}/chunks")
    groups = spark.read.parquet(f"{path}/chunks").count() // CHUNKS_IN_GROUP + 1
    run = parse_chunks(stream, many=False, columns=["kind", "offset"], groups=groups).writeStream.format("parquet").option("checkpointLocation", f"{path}/state").option("path", f"{path}/tokens").trigger(availableNow=True).start()
    run.awaitTermination()
    tokens = spark.read.schema("stream_id string, kind string, offset long").parquet(f"{path}/tokens")
    return tokens.groupBy("stream_id").agg(F.count(F.lit(1)).alias("n_tokens"), F.sum((F.col("kind") == "Err").cast("long")).alias("n_errors"), F.max("offset").alias("last_offset"))
