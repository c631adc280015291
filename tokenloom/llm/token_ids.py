"""Token ids in binary files, by Simple-8b: word-aligned coding in 64-bit words.

A word has a selector in its top four bits and, below, as many ids of equal width as its selector says.
Selector 15 is the escape: the next word is one whole number.  A segment holds whole documents, in blocks
of at most BLOCK ids; per-block offsets let blocks be decoded each on its own, and within one all words of
a selector at once.

Segment, all little-endian: magic `TLS8`, uint32 salt, then uint64 each: number of the file, ids in it
before, number of documents, of blocks, of words; int64 document ids; uint8 flags (1: the id is null); uint64 ids per document; uint64 word
offset and uint64 id count per block; the words, each XORed with the salt in both halves.

A file is a row of segments, each followed by SYNC.  Spark's text writer puts SYNC there (as its line
separator) and its reader splits at it, so files go to any store Spark can write, under its commit
protocol, and large ones are read in parallel.  The salt is the first for which SYNC isn't in the segment.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import stage, whole_text
from tokenloom.llm.tokenizing import encoder

MAGIC = b"TLS8"
SYNC = "\x1eTLS8\x1e\x04\n"
BLOCK = 4096
#: Ids to a word by selector: the most for each width up to 60 bits.
WIDTHS = [1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60]
COUNTS = [60 // w for w in WIDTHS]
ESCAPE = 15
SEGMENT_IDS = 1 << 20


def _choices(rows: np.ndarray, block: int) -> np.ndarray:
    """For each id of each row the selector with the most ids that all fit from there on.

    The most bits in a run of ids come from two runs of a power of two, so each selector is one comparison.
    """
    bits = np.maximum(1, np.frexp(rows.astype(np.float64))[1]).astype(np.uint8)
    bits[rows >= np.uint64(1 << 52)] = 64
    choice = np.full((len(rows), block), ESCAPE, np.uint8)
    most, run = bits, 1  # the most bits in `run` ids from each place on
    for s in range(len(WIDTHS) - 1, -1, -1):
        while 2 * run <= COUNTS[s]:
            most, run = np.maximum(most[:, :-run], most[:, run:]), 2 * run
        behind = COUNTS[s] - run
        fits = np.maximum(most[:, :block], most[:, behind : behind + block]) <= WIDTHS[s]
        if not fits.any():
            break
        choice[fits] = s
    return choice.ravel()


def encode_blocks(ids: np.ndarray, block: int = BLOCK) -> list[np.ndarray]:
    """uint64 ids -> Simple-8b words of each block of ids.

    Greedy from the left: the selector with the most ids that all fit; a block's last word may have spare
    places (the block's id count tells).  An id of over 60 bits takes an escape and a word of its own.
    """
    n = len(ids)
    if not n:
        return []
    full, odd = divmod(n, block)
    rows = np.zeros((full + (odd > 0), block + COUNTS[0]), np.uint64)  # zeros behind a block's end fit any width
    rows[:full, :block] = ids[: full * block].reshape(full, block)
    if odd:
        rows[full, :odd] = ids[full * block :]
    choice = _choices(rows, block)
    step, starts = np.array([*COUNTS, 1, 1], np.uint8)[choice].tobytes(), []
    for at in range(0, n, block):
        end = min(at + block, n)
        while at < end:
            starts.append(at)
            at += step[at]
    starts = np.array(starts, np.int64)
    chosen, places = choice[starts], starts + starts // block * COUNTS[0]
    escaped = chosen == ESCAPE
    where = np.arange(len(starts)) + np.cumsum(escaped) - escaped
    words, flat = np.zeros(len(starts) + int(escaped.sum()), np.uint64), rows.ravel()
    for s in np.unique(chosen).tolist():
        mine = np.flatnonzero(chosen == s)
        word, place = np.full(len(mine), s << 60, np.uint64), places[mine]
        if s == ESCAPE:
            words[where[mine] + 1] = flat[place]
        else:
            for j in range(COUNTS[s]):
                word |= flat[place + j] << np.uint64(j * WIDTHS[s])
        words[where[mine]] = word
    begins = where[np.searchsorted(starts, np.arange(block, n, block))]
    return np.split(words, begins)


def decode_block(words: np.ndarray, n: int) -> np.ndarray:
    """The first n ids of a block's words."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    if (selectors == ESCAPE).any():  # a raw word may look like anything: mark those behind an escape, in turn
        raw = np.zeros(len(words), bool)
        for i in np.flatnonzero(selectors == ESCAPE).tolist():
            if not raw[i]:
                raw[i + 1] = True
        selectors = np.where(raw, 14, selectors)
    counts = np.array([*COUNTS, 1, 0])[selectors]  # 14: a raw word
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in np.unique(selectors).tolist():
        mine = np.flatnonzero(selectors == s)
        word, place = words[mine], starts[mine]
        if s == 14:
            out[place] = word
        elif s != ESCAPE:
            mask = np.uint64((1 << WIDTHS[s]) - 1)
            for j in range(COUNTS[s]):
                out[place + j] = word >> np.uint64(j * WIDTHS[s]) & mask
    return out[:n]


def encode_segment(number: int, before: int, doc_ids: list[int | None], tokens: list[np.ndarray]) -> bytes:
    """Documents and their ids as a segment of file `number`, behind `before` ids."""
    ids = np.concatenate(tokens).astype(np.uint64) if tokens else np.zeros(0, np.uint64)
    blocks = encode_blocks(ids)
    sizes = np.array([len(b) for b in blocks], "<u8")
    words = np.concatenate(blocks) if blocks else np.zeros(0, np.uint64)
    head = np.array([number, before, len(doc_ids), len(blocks), len(words)], "<u8").tobytes()
    head += np.array([d or 0 for d in doc_ids], "<i8").tobytes() + bytes(d is None for d in doc_ids)
    head += np.array([len(t) for t in tokens], "<u8").tobytes()
    head += (np.cumsum(sizes) - sizes).astype("<u8").tobytes() + np.array([min(BLOCK, len(ids) - i) for i in range(0, len(ids), BLOCK)], "<u8").tobytes()
    for salt in range(1 << 32):
        mixed = (words ^ np.uint64(salt << 32 | salt)).astype("<u8").tobytes()
        out = MAGIC + salt.to_bytes(4, "little") + head + mixed
        if SYNC.encode() not in out + SYNC.encode()[:-1]:
            return out
    raise ValueError("no salt keeps the marker out")


def decode_segment(data: bytes) -> tuple[int, int, list[int | None], list[np.ndarray]]:
    """What encode_segment was given."""
    if data[:4] != MAGIC:
        raise ValueError("not a segment")
    salt = int.from_bytes(data[4:8], "little")
    number, before, n_docs, n_blocks, n_words = np.frombuffer(data, "<u8", 5, 8).tolist()
    at = 48
    doc_ids = np.frombuffer(data, "<i8", n_docs, at).tolist()
    at += 8 * n_docs
    doc_ids = [None if null else d for d, null in zip(doc_ids, data[at : at + n_docs], strict=True)]
    at += n_docs
    lengths = np.frombuffer(data, "<u8", n_docs, at).astype(np.int64)
    at += 8 * n_docs
    offsets = np.frombuffer(data, "<u8", n_blocks, at).tolist()
    counts = np.frombuffer(data, "<u8", n_blocks, at + 8 * n_blocks).tolist()
    at += 16 * n_blocks
    if len(data) != at + 8 * n_words:
        raise ValueError("a segment is cut short")
    words = np.frombuffer(data, "<u8", n_words, at) ^ np.uint64(salt << 32 | salt)
    ends = [*offsets[1:], n_words]
    blocks = [decode_block(words[a:b], n) for a, b, n in zip(offsets, ends, counts, strict=True)]
    ids = np.concatenate(blocks) if blocks else np.zeros(0, np.uint64)
    return number, before, doc_ids, np.split(ids, np.cumsum(lengths)[:-1]) if n_docs else []


def _segments(batches: Iterable[pa.RecordBatch], vocabulary: str, end_id: int, segment_ids: int) -> Iterator[pa.RecordBatch]:
    encode, number = encoder(vocabulary), TaskContext.get().partitionId()
    doc_ids, tokens, held, before = [], [], 0, 0

    def flush():
        return pa.RecordBatch.from_arrays([pa.array([encode_segment(number, before, doc_ids, tokens)], pa.binary())], ["value"])

    for batch in batches:
        names = batch.column(0).to_pylist()
        for part, ids, counts in encode.slices(batch.column(1), end_id):
            for doc_id, got in zip(names[part], np.split(ids, np.cumsum(counts)[:-1]), strict=True):
                doc_ids.append(doc_id)
                tokens.append(got)
                held += len(got)
                if held >= segment_ids:
                    yield flush()
                    doc_ids, tokens, held, before = [], [], 0, before + held
    if doc_ids:
        yield flush()


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int, files: int | None = None, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode (doc_id, text) and write the ids below path in ascending doc_id order, end_id behind each document.

    Documents are dealt out by ranges of doc_id (rows that share one by their text too), so each task writes
    one file, and files follow each other in the order of their numbers.  files: how many (the session's
    shuffle partitions).  Null text: the end id alone.  Null doc_ids come first.
    """
    spark = docs.sparkSession
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    ranged = texts.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    made = ranged.mapInArrow(partial(_segments, vocabulary=vocabulary, end_id=end_id, segment_ids=segment_ids), "value binary")
    made.select(F.col("value").cast("string")).write.text(path, lineSep=SYNC)


def _documents(batches: Iterable[pa.RecordBatch], ids: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(0):
            number, before, doc_ids, tokens = decode_segment(data.as_py())
            small = [t.astype("<u4") for t in tokens]
            sizes = np.array([len(t) for t in tokens], np.int64)
            columns = [
                pa.array(doc_ids, pa.int64()),
                pa.array([number] * len(doc_ids), pa.int64()),
                pa.array(before + np.cumsum(sizes) - sizes),
                pa.array(sizes),
                pa.array([zlib.crc32(t.tobytes()) for t in small], pa.int64()),
            ]
            names = ["doc_id", "file", "at", "n_tokens", "ids_crc32"]
            if ids:
                columns.append(pa.array([t.tolist() for t in small], pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)


def read(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """The documents in the files below path: doc_id, file, at (ids before it in the file), n_tokens, ids_crc32 and, if asked for, ids."""
    lines = spark.read.text(path, lineSep=SYNC).select(F.col("value").cast("binary"))
    schema = "doc_id long, file long, at long, n_tokens long, ids_crc32 long" + (", ids array<long>" if ids else "")
    return lines.mapInArrow(partial(_documents, ids=ids), schema)


def placed(documents: DataFrame) -> DataFrame:
    """Adds start: the ids of all documents before a document, in the order of the files.

    Each file's own offsets are in its segments, so only totals, one row a file, are summed in order.
    """
    held = stage(documents, "token-ids-read")
    totals = held.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    return held.join(stage(before, "token-ids-files"), "file").withColumn("start", F.col("before") + F.col("at")).drop("before", "at")


def written(docs: DataFrame, path: str, vocabulary: str, end_id: int, files: int | None = None) -> DataFrame:
    """Write the documents' ids, read the files back: doc_id, start, n_tokens, ids_crc32 (unsigned), file."""
    write(docs, path, vocabulary, end_id, files)
    return placed(read(docs.sparkSession, path)).select("doc_id", "start", "n_tokens", "ids_crc32", "file")
