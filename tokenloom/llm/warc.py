"""A content-addressed WARC archive.

Payload bytes are stored once, in the `response` record of the smallest id that has them, addressed by
SHA-256; every other capture keeps its exact header block alone, as a `revisit` record that names that
digest.  Original records come back by joining headers with payloads on the digest.

Files are WARC/1.0, gzip-compressed as a whole, written by Spark's text writer with the record separator
`\\r\\n\\r\\n`, so they land on any file system Spark can write to, under its commit protocol, and lost tasks
leave nothing behind.  Reading takes the same way: the text reader's lines, put together again, are the
exact bytes of the file, and a stream parser that trusts Content-Length alone cuts them into records, so
blank lines inside a payload do no harm.  A gzip file isn't split, so no record spans two tasks.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm.common import stage

CRLF = "\r\n"
END = CRLF * 2
#: The alphabet of base 32 (RFC 4648), fixed values.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
FIELDS = "record_id string, record_type string, page_id long, url string, header binary, payload_bytes long, sha1 string, sha256 string, refers_to_id string"


def base32(digest_hex: Column) -> Column:
    """Upper-case base 32 of a hexadecimal digest of a whole number of 20-bit groups (SHA-1: 8)."""
    fives = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substr(digest_hex, i * 5 + 1, F.lit(5)), 16, 10).cast("int"))
    letter = lambda x, shift: F.substr(F.lit(BASE32), F.shiftright(x, shift).bitwiseAND(31) + 1, F.lit(1))
    return F.array_join(F.transform(fives, lambda x: F.concat(*(letter(x, s) for s in (15, 10, 5, 0)))), "")


def addressed(pages: DataFrame, payload: str = "html") -> DataFrame:
    """pages (page_id, url, payload) -> with the payload's bytes, SHA-1 and SHA-256.  Null payload: no bytes."""
    data = F.coalesce(F.col(payload).cast("string").cast("binary"), F.lit(b""))
    out = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), data.alias("payload"))
    return out.withColumns({"sha1": F.sha1("payload"), "sha256": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")})


def first_holders(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(sha256, holder): of each payload held by two ids or more, the smallest id."""
    groups = records.where(F.col("payload_bytes") >= least_bytes).groupBy("sha256")
    shared = groups.agg(F.min("page_id").alias("holder"), F.max("page_id").alias("last"))
    return stage(shared.where("holder < last").select("sha256", "holder"), "warc-holders")


def _record_id(page_id: Column) -> Column:
    h = F.sha1(F.concat(F.lit("page "), F.coalesce(page_id.cast("string"), F.lit("null"))))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substr(h, F.lit(a), F.lit(n)) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def write(pages: DataFrame, path: str, payload: str = "html", least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write one WARC record per row of (page_id, url, payload) below path.

    Rows with equal payloads of least_bytes or more: those with the smallest page_id are `response`
    records, all others `revisit` ones without a block.  Null payload: an empty one.  Null url: no target
    URI.  Null page_id: a `response` of its own.  Repeated rows give repeated records.  Line breaks in a
    URL are percent-encoded.
    """
    records = addressed(pages, payload)
    joined = records.join(first_holders(records, least_bytes), "sha256", "left")
    revisit = (F.col("payload_bytes") >= least_bytes) & (F.col("page_id") > F.col("holder"))
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    optional = lambda name, value: F.coalesce(field(name, value), F.lit(""))
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=UTF-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    block = F.when(revisit, F.lit(b"")).otherwise(F.concat(http.cast("binary"), F.col("payload")))
    header = F.concat(
        F.lit(f"WARC/1.0{CRLF}"),
        field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        field("WARC-Record-ID", _record_id(F.col("page_id"))),
        field("WARC-Date", F.lit(date)),
        optional("WARC-Target-URI", uri),
        optional("WARC-Page-ID", F.col("page_id").cast("string")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        field("WARC-Payload-SHA256", F.col("sha256")),
        F.when(revisit, F.concat(field("WARC-Profile", F.lit(REVISIT_PROFILE)), field("WARC-Refers-To", _record_id(F.col("holder"))))).otherwise(""),
        field("Content-Type", F.lit("application/http; msgtype=response")),
        F.lit("Content-Length: "),
        F.octet_length("block").cast("string"),
        F.lit(END),
    )
    value = F.concat(header.cast("binary"), F.col("block")).cast("string")
    joined.withColumn("block", block).select(value.alias("value")).write.text(path, compression="gzip", lineSep=END)


def _fields(header: bytes) -> dict[str, str]:
    lines = header.decode().split(CRLF)[1:]
    return {name.lower(): value for name, _, value in (line.partition(": ") for line in lines)}


def _parsed(header: bytes, block: bytes) -> tuple[dict, bytes]:
    """A record's columns and payload; a payload that isn't what its digest says is an error."""
    f = _fields(header)
    page = f.get("warc-page-id")
    row = {"record_id": f["warc-record-id"], "record_type": f["warc-type"], "page_id": None if page is None else int(page), "url": f.get("warc-target-uri"), "header": header, "refers_to_id": f.get("warc-refers-to"), "sha1": f["warc-payload-digest"].removeprefix("sha1:"), "sha256": f["warc-payload-sha256"], "payload_bytes": None}
    if row["record_type"] == "revisit":
        return row, b""
    payload = block.partition(END.encode())[2]
    if hashlib.sha256(payload).hexdigest() != row["sha256"] or base64.b32encode(hashlib.sha1(payload).digest()).decode() != row["sha1"]:
        raise ValueError(f"{row['record_id']}: the payload doesn't match its digest")
    return row | {"payload_bytes": len(payload)}, payload


def _records(batches: Iterable[pa.RecordBatch], payloads: bool, rows: int = 256, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in FIELDS.split(", ")] + ["payload"] * payloads
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "header": pa.binary(), "payload": pa.binary()}
    schema = pa.schema([(n, kinds.get(n, pa.string())) for n in names])
    end, held, out, held_bytes = END.encode(), bytearray(), [], 0

    def flush():
        return pa.RecordBatch.from_pylist(out, schema=schema)

    need = 0
    for batch in batches:
        for line in batch.column(0):
            held += line.as_py() + end
            while len(held) >= need:
                if not need:  # a payload's own line breaks can leave some of the separator's behind it
                    del held[: len(held) - len(held.lstrip(CRLF.encode()))]
                if (at := held.find(end)) < 0:
                    break
                header = bytes(held[:at])
                need = at + len(end) + int(_fields(header)["content-length"])
                if len(held) < need:
                    break
                block = bytes(held[at + len(end) : need])
                del held[:need]
                need = 0
                row, payload = _parsed(header, block)
                out.append(row | ({"payload": payload} if payloads else {}))
                held_bytes += len(payload) * payloads + len(header)
                if len(out) >= rows or held_bytes >= size:
                    yield flush()
                    out, held_bytes = [], 0
    del held[: len(held) - len(held.lstrip(CRLF.encode()))]
    if held:
        raise ValueError("the archive ends inside a record")
    yield flush()


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The archive's records: the fields above, header (its exact bytes) and, if asked for, payload.

    Every response is held against both of its digests.  A revisit has no payload_bytes and an empty payload.
    """
    lines = spark.read.text(path, lineSep=END).select(F.col("value").cast("binary"))
    return lines.mapInArrow(partial(_records, payloads=payloads), FIELDS + (", payload binary" if payloads else ""))


def restored(records: DataFrame) -> DataFrame:
    """Records with payload_bytes (and payload, if read) of revisits filled in from their digest's response.

    A revisit's digests are held against those of the response, which were held against its bytes; a revisit
    whose response is missing or differs is an error.  One payload joins many headers; the payload side is staged with one row per digest, be its response
    repeated.  Both sides are plain tables if the caller staged records, so a digest with many revisits is
    split between tasks.
    """
    more = [c for c in ("payload_bytes", "payload") if c in records.columns]
    held = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), *(F.col(c).alias(f"full_{c}") for c in (*more, "sha1", "sha256")), F.col("page_id").alias("held_by"))
    held = stage(held.dropDuplicates(["refers_to_id"]), "warc-held")
    joined = records.where("record_type = 'revisit'").drop(*more).join(held, "refers_to_id", "left")
    same = (F.col("full_sha256") == F.col("sha256")) & (F.col("full_sha1") == F.col("sha1"))
    wrong = F.raise_error(F.concat(F.col("record_id"), F.lit(": refers to no response with its digest"))).cast("string")
    full = joined.withColumn("sha1", F.when(same, F.col("full_sha1")).otherwise(wrong)).drop("full_sha1", "full_sha256").withColumnsRenamed({f"full_{c}": c for c in more})
    rest = records.where("record_type = 'response'").withColumn("held_by", F.lit(None).cast("long"))
    return full.unionByName(rest)


def archived(pages: DataFrame, path: str, payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write pages to WARC files below path, read them back and return a row per record.

    (page_id, payload_bytes, payload_digest, record_type, refers_to, url): size and bare base-32 SHA-1 of the
    full payload, and for a revisit the id of the response it refers to.  No rows give no files' records.
    """
    write(pages, path, payload, least_bytes)
    records = stage(read(pages.sparkSession, path, payloads=False).drop("header"), "warc-records")
    back = restored(records)
    return back.select("page_id", "payload_bytes", F.col("sha1").alias("payload_digest"), "record_type", F.col("held_by").alias("refers_to"), "url")
