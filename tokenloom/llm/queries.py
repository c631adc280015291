"""The operators as registered queries over their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import decontaminate, packing, pii, quality, secret_scan, simhash, token_counts, token_ids, url_filters, warc
from tokenloom.llm.common import fresh_path, read_table
from tokenloom.llm.sql import oracles

END_ID = 2
#: A dated block list over hosts and domains of `pages`: (list, domain, action, instant).
LIST_ENTRIES = [
    ("malware", "tionsh.example.net", "add", "2024-02-01 00:00:00"),
    ("malware", "tionsh.example.net", "remove", "2024-04-15 12:00:00"),
    ("malware", "tionsh.example.net", "add", "2024-09-01 00:00:00"),
    ("malware", "blog.tionble.example.com", "add", "2024-03-10 06:00:00"),
    ("malware", "ththth.example.net", "add", "2024-05-01 00:00:00"),
    ("malware", "ththth.example.net", "remove", "2024-05-01 00:00:00"),
    ("adult", "example.org", "add", "2024-06-01 00:00:00"),
    ("adult", "example.org", "remove", "2024-07-01 00:00:00"),
    ("adult", "thther.example.org", "add", "2024-01-15 00:00:00"),
    ("adult", "THTHHE.example.com", "add", "2024-11-01 00:00:00"),
    ("adult", "ththhe.example.com", "add", "2024-11-20 00:00:00"),
    ("optout", "tiontion.example.com", "add", "2024-01-01 00:00:00"),
    ("optout", "tiontion.example.com", "remove", "2024-12-24 00:00:00"),
    ("optout", "example.net", "add", "2024-12-01 00:00:00"),
    ("paths", "Example.ORG./en/", "ADD", "2024-03-01 00:00:00"),
    ("paths", "example.com/fr", "add", "2024-01-01 00:00:00"),
]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages against the list as of their fetch, an instant of 2024 derived from page_id (pages have none)."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    hours = F.pmod(F.col("page_id") * 7919, F.lit(8784))
    told = (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=hours.cast("int"))).cast("string")  # UTC, whatever the session's zone
    entries = spark.createDataFrame(LIST_ENTRIES, "list_name string, domain string, action string, at string")
    out = url_filters.as_of(pages.withColumns({"told": told, "fetched": F.timestamp_seconds(F.lit(1704067200) + hours * 3600)}), entries)
    return out.select("page_id", "host", F.col("told").alias("fetched"), "n_active", "active_lists", "blocked")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per page, repeated ones too; null html is an empty payload, a null page_id a response of its own.  See `warc.write`."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.archived(pages, fresh_path(spark, "warc")).drop("url")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document, repeated ones too; null and wordless texts have fingerprint zero.  See `simhash.near_duplicates`."""
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document, repeated ones too; null text has no words and fails.  See `quality.assessed`."""
    return quality.figures(read_table(spark, sf_dir, "documents"))


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document, repeated ones too; null text is the end id alone, null doc_ids come first.  See `token_ids.write`."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_ids.written(docs, fresh_path(spark, "token-ids"), public_tokenizers.path("byte_bpe_50k.json"), END_ID).drop("file")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document, repeated ones too; null and empty texts have no tokens.  See `token_counts.model_counts`."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.model_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document, repeated ones too; null text has no words.  See `decontaminate.contamination`."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document, repeated ones too; null text is empty.  See `secret_scan.findings`."""
    found = secret_scan.findings(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return secret_scan.digests(found).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per piece; repeated rows are packed each, null text is the end id alone.  See `packing.packed`."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document, repeated ones too; null text has no spans.  See `pii.personal_data`."""
    found = pii.personal_data(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    told = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    of_kind = lambda kind: lambda s: s["kind"] == kind
    kinds = pii.KINDS[:4]
    base = F.filter("pii", lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id",
        *(F.size(F.filter("pii", of_kind(k))).cast("long").alias(f"n_{k}") for k in kinds),
        F.sha2(F.array_join(F.transform(base, told), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("pii", told), ",").alias("spans"),
        F.array_join(F.transform("pii", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_url_filters, op2_warc, op3_simhash, op4_quality_rules, op5_token_ids, op6_token_counts, op7_decontamination, op8_secret_scans, op9_packing, op10_pii)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return oracles(LIST_ENTRIES)
