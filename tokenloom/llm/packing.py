"""Packing by non-negative least squares.

Whole windows of a document are sequences of their own.  What is left of each is a length below the window,
counted by classes of `grain` tokens.  Combinations of at most three classes that fill a window are
enumerated, non-negative least squares finds how often to use each so that the histogram is met, the
counts are rounded down to what there is, and lengths join their combinations by rank.  A class holds
lengths from its lower end up, so a combination holds a window or a little more, and its longest member is
cut where the window is full.  The cut ends and all lengths left over are packed greedily, one behind the
other, cut at the windows' ends.  Only the last sequence of all has padding.

The driver sees one count per class.  Ranks and offsets are counts per bucket of rows, added up over
buckets, and windows within one bucket, so no class or length, however common, is one task's work.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import keep_last, stage, staged_paths, whole_text
from tokenloom.llm.tokenizing import encoder

LENGTH = 4096
GRAIN = 64
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def combinations(classes: int) -> list[tuple[int, ...]]:
    """Ascending pairs and triples of class numbers from 1 that add up to `classes`."""
    pairs = [(a, classes - a) for a in range(1, classes // 2 + 1)]
    triples = [(a, b, classes - a - b) for a in range(1, classes // 3 + 1) for b in range(a, (classes - a) // 2 + 1)]
    return pairs + triples


def repeats(histogram: np.ndarray, combos: list[tuple[int, ...]], sweeps: int = 300) -> np.ndarray:
    """How often to use each combination: least squares against the histogram, none negative, rounded.

    Coordinate descent on the normal equations; then each count is cut to what is left of its classes, the
    largest first, and a last pass uses up what rounding has left.
    """
    use = np.zeros((len(histogram), len(combos)))
    for j, combo in enumerate(combos):
        for c in combo:
            use[c, j] += 1
    gram, x = use.T @ use, np.zeros(len(combos))
    slope = -(use.T @ histogram.astype(float))
    for _ in range(sweeps):
        moved = 0.0
        for j in range(len(combos)):
            step = max(-x[j], -slope[j] / gram[j, j])
            if step:
                x[j] += step
                slope += step * gram[:, j]
                moved = max(moved, abs(step))
        if moved < 0.25:
            break
    left, out = histogram.astype(np.int64).copy(), np.zeros(len(combos), np.int64)
    for most in (np.floor(x).astype(np.int64), np.full(len(combos), np.iinfo(np.int64).max)):
        for j in np.argsort(-x, kind="stable").tolist():
            n = min(int(most[j]), *(int(left[c] // combos[j].count(c)) for c in combos[j]))
            out[j] += n
            for c in combos[j]:
                left[c] -= n
    return out


def _tokens(batches: Iterable[pa.RecordBatch], vocabulary: str, end_id: int) -> Iterator[pa.RecordBatch]:
    encode, part, row = encoder(vocabulary), TaskContext.get().partitionId(), 0
    for batch in batches:
        names = batch.column(0)
        for cut, ids, counts in encode.slices(batch.column(1), end_id):
            n = len(counts)
            uids = (part << 40) + np.arange(row, row + n, dtype=np.int64)
            row += n
            edge = np.concatenate(([0], np.cumsum(counts))) * ids.itemsize
            data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(edge), pa.py_buffer(ids)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([names.slice(cut.start, n), pa.array(uids), pa.array(counts), data], ["doc_id", "uid", "n", "ids"])


def tokens(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """(doc_id, text) -> staged (doc_id, uid, n, ids): whole texts' ids with end_id behind, 2 bytes each where they fit."""
    texts = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    made = texts.mapInArrow(partial(_tokens, vocabulary=vocabulary, end_id=end_id), "doc_id long, uid long, n long, ids binary")
    return stage(made, "packing-tokens")


def _before(df: DataFrame, keys: list[str], value: Column, out: str) -> DataFrame:
    """Adds the sum of value over the rows before a row, by keys (if any), then bucket, then uid."""
    by = df.groupBy(*keys, "bucket").agg(F.sum(value).alias("_n"))
    order = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy("bucket")
    by = stage(by.withColumn("_base", F.sum("_n").over(order) - F.col("_n")).drop("_n"), "packing-before")  # a row for each bucket (and class), of known size
    rows = Window.partitionBy(*keys, "bucket").orderBy("uid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = df.withColumn("_upto", F.sum(value).over(rows) - value)
    on = [*keys, "bucket"]
    return within.join(by, on).withColumn(out, F.col("_base") + F.col("_upto")).drop("_base", "_upto")


def plan(lengths: DataFrame, length: int = LENGTH, grain: int = GRAIN, buckets: int = 64) -> DataFrame:
    """(uid, n) -> staged (uid, n, whole_seq, seq, offset, taken, rest_at), where each document goes.

    whole_seq: sequence of its first whole window (the others follow).  seq, offset, taken: where the tokens
    behind the whole windows begin and how many of them lie there (0: none).  rest_at: where what then is
    left begins in the row of residuals, as a token number over all sequences.

    Any grain from 1 on will do; the last class is narrower where length is no multiple of it, and with a
    grain of length or more nothing combines and all lengths are residuals.  No rows give none.
    """
    if length < 1 or grain < 1:
        raise ValueError("length and grain: 1 or more")
    df = lengths.select("uid", "n").withColumns({"whole": F.floor(F.col("n") / length), "left": F.col("n") % length})
    df = df.withColumns({"class": F.floor(F.col("left") / grain), "bucket": F.pmod(F.xxhash64("uid"), F.lit(buckets))})
    df = stage(df, "packing-lengths")
    counts = df.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()  # one row a class
    classes = -(-length // grain)
    histogram = np.zeros(classes, np.int64)
    for row in counts:
        histogram[row["class"]] = row["n"]
    histogram[0] = 0
    most = lambda combo: sum(min((c + 1) * grain, length) - 1 for c in combo[:-1])
    combos = [c for c in combinations(classes) if most(c) < length]  # else the window may be full before the last member
    times = repeats(histogram, combos)
    ranges, first, used = [], 0, {}
    for combo, n in zip(combos, times.tolist(), strict=True):
        for slot, c in enumerate(combo if n else ()):
            ranges.append((c, used.get(c, 0), used.get(c, 0) + n, first, slot, slot == len(combo) - 1))
            used[c] = used.get(c, 0) + n
        first += n
    spark = lengths.sparkSession
    ranges = spark.createDataFrame(ranges, "class long, lo long, hi long, first long, slot int, last boolean")  # a row for each class of a combination in use
    ranked = _before(df, ["class"], F.lit(1).cast("long"), "rank")
    on = (ranked["class"] == ranges["class"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    placed = ranked.join(F.broadcast(ranges), on, "left").drop(ranges["class"])
    placed = placed.withColumn("seq", F.col("first") + F.col("rank") - F.col("lo")).select("uid", "n", "whole", "left", "bucket", "seq", "slot", "last")
    free = placed.where("seq is null").withColumns({"offset": F.lit(0).cast("long"), "taken": F.lit(0).cast("long")})
    by_seq = Window.partitionBy("seq").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    joined = placed.where("seq is not null").withColumn("offset", F.coalesce(F.sum("left").over(by_seq), F.lit(0).cast("long")))
    joined = joined.withColumn("taken", F.when(F.col("last"), length - F.col("offset")).otherwise(F.col("left")))
    df = stage(joined.unionByName(free).drop("slot", "last"), "packing-placed")
    df = _before(df, [], F.col("whole"), "whole_seq")
    df = _before(df, [], F.col("left") - F.col("taken"), "rest_at")
    n_whole = df.agg(F.coalesce(F.sum("whole"), F.lit(0))).first()[0]
    wholes = F.lit(first) + F.col("whole_seq")
    rests = F.lit((first + n_whole) * length).cast("long") + F.col("rest_at")  # multiplied here: Spark takes small numbers for ints, and 2^31 tokens overflow
    return df.select("uid", wholes.alias("whole_seq"), "seq", "offset", "taken", rests.alias("rest_at"))


def _cut(n: int, whole_seq: int, seq: int | None, offset: int, taken: int, rest_at: int, length: int) -> list[tuple[int, int, int, int]]:
    """A document's pieces: (start, length, sequence, offset)."""
    whole = n // length
    out = [(i * length, length, whole_seq + i, 0) for i in range(whole)]
    at = whole * length
    if taken:
        out.append((at, taken, seq, offset))
        at += taken
    while at < n:
        fits = min(n - at, length - rest_at % length)
        out.append((at, fits, rest_at // length, rest_at % length))
        at, rest_at = at + fits, rest_at + fits
    return out


def _pieces(batches: Iterable[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _PIECES.split(", ")]
    for batch in batches:
        columns = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names) if n != "ids"}
        data, out = batch.column(batch.schema.get_field_index("ids")), []
        for i, (doc_id, n, *where) in enumerate(zip(*(columns[c] for c in ("doc_id", "n", "whole_seq", "seq", "offset", "taken", "rest_at")), strict=True)):
            raw = data[i].as_py()
            ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4").tobytes()
            for start, size, seq, offset in _cut(n, *where, length):
                out.append((doc_id, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), n, seq, offset))
        yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*out, strict=True)] or [pa.array([], pa.int64())] * len(names), names)


def packed(docs: DataFrame, vocabulary: str, end_id: int, length: int = LENGTH, grain: int = GRAIN, buckets: int | None = None) -> DataFrame:
    """(doc_id, text) -> a row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null text is one end id.  Repeated rows and null doc_ids are documents of their own.  No rows give none.
    Other columns are ignored, whatever their names; doc_id is cast to long (null where it is no number).
    sequence_id runs from 0 without a gap, and offsets in a sequence without one too.
    """
    n = buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = tokens(docs, vocabulary, end_id)
    since = len(staged_paths())
    where = stage(plan(held, length, grain, n), "packing-plan")
    keep_last(docs.sparkSession, since)
    joined = held.join(where.hint("shuffle_hash"), "uid")
    return joined.select("doc_id", "n", "whole_seq", "seq", "offset", "taken", "rest_at", "ids").mapInArrow(partial(_pieces, length=length), _PIECES)
