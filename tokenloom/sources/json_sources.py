"""Where JSON texts come from: files, lines, record sequences, concatenations and ordered chunks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.operators.json_texts import ERROR, extract, validate
from tokenloom.plans.diagnosis import position_text

#: What RFC 7464 puts before each text.
RECORD_SEPARATOR = "\x1e"


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): a text a line.  Lines of blanks alone are no texts.  Files are split between tasks."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return lines.where(F.trim(F.translate("text", "\t\r", "  ")) != "")


def json_sequences(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): the texts of RFC 7464 sequences, without their separators."""
    rows = spark.read.text(path, lineSep=RECORD_SEPARATOR).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return rows.where(F.trim(F.translate("text", "\t\r\n", "   ")) != "")


def json_files(spark: SparkSession, path: str, skip_unreadable: bool = False) -> DataFrame:
    """(path, text): a text a file.  A file that can't be read fails the job, or is left out; `read_errors` lists those."""
    read = spark.read.option("ignoreCorruptFiles", skip_unreadable).option("ignoreMissingFiles", skip_unreadable)
    return read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_errors(spark: SparkSession, path: str) -> DataFrame:
    """(path, err): the files below path that can't be read as text (a compressed file cut short, say), as errors of class read.

    Every file is read once to know.  How much of a file was good isn't known, so positions are its start.
    """
    listed = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("path"))
    missing = listed.join(json_files(spark, path, True).select("path"), "path", "left_anti")
    start = {"offset": 0, "line": 1, "col": 1}
    err = {"class": "read", "variant": "Read", "token_pos": start, "err_pos": start, "message": f"read error at {position_text(0, 1, 1)}"}
    return missing.select("path", F.from_json(F.lit(json.dumps(err)), ERROR).alias("err"))


def validated_files(spark: SparkSession, path: str, **options) -> DataFrame:
    """(path, is_valid, err): a row a file; files that can't be read are invalid by an error of class read."""
    good = validate(json_files(spark, path, True), columns=["is_valid", "err"], **options)
    return good.unionByName(read_errors(spark, path).withColumn("is_valid", F.lit(False)))


def json_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(path, text binary): a text a file, its bytes as they are, for texts that may break UTF-8."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("text"))


def concatenated(docs: DataFrame, text: str = "text", max_level: int = 128) -> DataFrame:
    """A row per value of texts that hold several, with or without blanks between: text_no from 0, and value.

    Values of a text before its first error are returned.
    """
    return extract(docs, [""], text, max_level, many=True).drop("i", "pointer", "kind")


def joined_chunks(chunks: DataFrame) -> DataFrame:
    """(stream_id, seq, chunk) -> (stream_id, text binary): each stream's chunks in the order of seq.

    A stream is one text, and so one row; its chunks may be cut at any byte.  Chunks that repeat a seq count
    once (the same bytes twice); null chunks are empty.
    """
    ordered = F.array_sort(F.collect_set(F.struct("seq", F.coalesce("chunk", F.lit(b"")).alias("chunk"))))
    groups = chunks.groupBy("stream_id").agg(ordered.alias("parts"))
    return groups.select("stream_id", F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["chunk"])), "")).alias("text"))
