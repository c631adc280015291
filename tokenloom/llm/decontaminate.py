"""Benchmark decontamination with suffix arrays over the training text.

The training words are cut into shards, one per batch of documents in a task.  In a shard, words become
the ids they have in the benchmark's vocabulary, and any other word is a break, for no match can hold
one.  All suffixes of the runs that a window fits in are sorted into the shard's suffix array (by doubling
prefixes, up to the length of the longest item); each test suffix is found in it by binary search, which gives
all the places its window stands at, and, as the search goes on word by word between neighbours, how far each
place's verbatim match goes.

The test side is read in blocks of bounded size, each broadcast.  One block, the common case, is searched for
where the documents lie and nothing is shuffled.  More take a pass over the documents each, and each is made when
the one before is destroyed, so that neither the driver nor a worker ever holds two; what the passes found is joined by row.
"""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator
from functools import partial
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import stage

WINDOW = 10
BLOCK_BYTES = 32 << 20
_KEPT = (string.ascii_letters + string.digits).encode() + bytes(range(0x80, 0x100))
_TABLE = bytes(b if b in _KEPT else 0x20 for b in bytes(range(256)).lower())
_OUT = "n_words long, n_hit long, item_ids array<string>, longest long, longest_item string, longest_at long, spans array<struct<start:long,end:long>>"
_SHARD_WORDS = 1 << 20


def words_of(text: bytes) -> list[bytes]:
    """The words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a UTF-8 text with A-Z lower-cased."""
    return text.translate(_TABLE).split()


class Block:
    """Some items' word ids, one after the other with a break (0) behind each, and their windows."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.ids: dict[bytes, int] = {}
        self.names: list[str | None] = []
        words: list[int] = []
        starts, widths, owners = [], [], []
        for name, text in items:
            own = [self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text)]
            if not own:
                continue
            width = min(window, len(own))
            places = range(len(words), len(words) + len(own) - width + 1)
            starts += places
            widths += [width] * len(places)
            owners += [len(self.names)] * len(places)
            self.names.append(name)
            words += [*own, 0]
        self.words = np.array(words, np.int32)
        self.starts, self.widths, self.owners = (np.array(x, np.int64) for x in (starts, widths, owners))
        self.longest = max((b - a for a, b in pairwise([-1, *np.flatnonzero(self.words == 0).tolist()])), default=1) - 1
        self.bits = max(1, len(self.ids).bit_length())


def _keys(words: np.ndarray, at: np.ndarray, width: int, bits: int) -> list[np.ndarray]:
    """The width words from each place on, packed into as few 64-bit numbers as hold them, in word order."""
    per = 64 // bits
    padded = np.concatenate((words, np.zeros(width, words.dtype))).astype(np.uint64)
    out = []
    for first in range(0, width, per):
        key = np.zeros(len(at), np.uint64)
        for j in range(first, min(first + per, width)):
            key = key << np.uint64(bits) | padded[at + j]
        out.append(key)
    return out


def _bounds(keys: list[np.ndarray], wanted: list[np.uint64], lo: int, hi: int) -> tuple[int, int]:
    """The rows from lo to hi of a sorted array of compound keys that equal wanted: a binary search a column."""
    for column, value in zip(keys, wanted, strict=True):
        part = column[lo:hi]
        lo, hi = lo + int(part.searchsorted(value, "left")), lo + int(part.searchsorted(value, "right"))
        if lo == hi:
            break
    return lo, hi


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """The places of words other than 0, sorted by the words from there on, up to depth of them; a 0 ends a suffix."""
    rank, k = words.astype(np.int64), 1
    solid = words > 0
    total = int(solid.sum())
    while k < depth:
        behind = np.concatenate((rank[k:], np.zeros(min(k, len(rank)), np.int64)))
        kinds, rank = np.unique(np.where(solid, rank * (int(rank.max(initial=0)) + 1) + behind, 0), return_inverse=True)
        k *= 2
        if len(kinds) >= total + (total < len(words)):
            break
    order = np.argsort(rank, kind="stable")
    return order[solid[order]]


def match_lengths(shard: np.ndarray, places: np.ndarray, words: np.ndarray, start: int, depth: int) -> np.ndarray:
    """How many words each suffix at places shares with the test suffix at start; depth of them it is known to.

    places: neighbours in the suffix array, so at each further word those that go on are between two bounds.
    """
    out, lo, hi = np.full(len(places), depth), 0, len(places)
    while lo < hi:
        out[lo:hi] = depth
        if not (word := words[start + depth]):
            break
        column = shard[places[lo:hi] + depth]
        lo, hi, depth = lo + int(column.searchsorted(word, "left")), lo + int(column.searchsorted(word, "right")), depth + 1
    return out


def _matches(shard: np.ndarray, block: Block) -> Iterator[tuple[np.ndarray, int, int, int]]:
    """Yields (its places in the shard, width, owner, place in the block) for each test suffix whose window is there.

    shard: word ids in the block's vocabulary, 0 for any other word and behind each document.
    """
    if not len(block.widths):
        return
    known = np.concatenate(([False], shard > 0, [False]))
    edges = np.flatnonzero(known[1:] != known[:-1])
    begins, ends = edges[::2], edges[1::2]
    wide = ends - begins >= block.widths.min()
    begins, ends = begins[wide], ends[wide]
    if not len(begins):
        return
    # the runs that some window fits in, each with the break behind it, one behind the other
    size = ends - begins + 1
    at = np.arange(int(size.sum())) + np.repeat(begins - (np.cumsum(size) - size), size)
    left = np.repeat(ends, size) - at
    array = suffix_array(np.where(left > 0, shard[np.minimum(at, len(shard) - 1)], 0), block.longest)
    array, left = at[array], left[array]
    for width in np.unique(block.widths).tolist():
        own = array[left >= width]  # suffixes that run on for a whole window
        keys = _keys(shard, own, width, block.bits)
        mine = np.flatnonzero(block.widths == width)
        tests = _keys(block.words, block.starts[mine], width, block.bits)
        lows = keys[0].searchsorted(tests[0], "left")
        highs = keys[0].searchsorted(tests[0], "right")
        for t in np.flatnonzero(lows < highs).tolist():
            lo, hi = _bounds(keys[1:], [k[t] for k in tests[1:]], int(lows[t]), int(highs[t]))
            if lo < hi:
                yield own[lo:hi], width, int(block.owners[mine[t]]), int(block.starts[mine[t]])


def _shard_rows(docs: list[list[bytes]], block: Block) -> list[dict]:
    lengths = np.array([len(d) for d in docs], np.int64)
    first = np.cumsum(lengths + 1) - lengths - 1
    total = int((lengths + 1).sum())
    marks = np.zeros(total + 1, np.int32)
    items: list[set] = [set() for _ in docs]
    best: list[tuple] = [(0, None, None)] * len(docs)
    get = block.ids.get
    shard = np.zeros(total, np.int32)
    for at, words in zip(first.tolist(), docs, strict=True):
        shard[at : at + len(words)] = np.fromiter((get(w, 0) for w in words), np.int32, len(words))
    pairs = []
    for places, width, owner, start in _matches(shard, block):
        np.add.at(marks, places, 1)
        np.add.at(marks, places + width, -1)
        of = np.searchsorted(first, places, "right") - 1
        pairs.append(np.unique(of) * len(block.names) + owner)
        before = shard[places - 1] * (places > 0)  # a match that goes on to the left was measured there
        opens = np.flatnonzero((before != block.words[start - 1]) | (before == 0)) if start else np.arange(len(places))
        if len(opens):
            sizes = match_lengths(shard, places, block.words, start, width)[opens]
            for d, p, n in zip(of[opens].tolist(), places[opens].tolist(), sizes.tolist(), strict=True):
                if n > best[d][0]:
                    best[d] = (n, block.names[owner], p - int(first[d]))
    for pair in np.unique(np.concatenate(pairs)).tolist() if pairs else ():
        items[pair // len(block.names)].add(block.names[pair % len(block.names)])
    covered = np.cumsum(marks)[:-1] > 0
    edges = np.diff(np.concatenate(([0], covered.astype(np.int8), [0])))
    opens, closes = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    of = np.searchsorted(first, opens, "right") - 1
    spans: list[list] = [[] for _ in docs]
    for d, a, b in zip(of.tolist(), opens.tolist(), closes.tolist(), strict=True):
        spans[d].append({"start": a - int(first[d]), "end": b - int(first[d])})
    return [
        {"n_words": len(w), "n_hit": sum(s["end"] - s["start"] for s in spans[i]), "item_ids": sorted(x for x in items[i] if x is not None), "longest": best[i][0], "longest_item": best[i][1], "longest_at": best[i][2], "spans": spans[i]}
        for i, w in enumerate(docs)
    ]


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_ADDED = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("item_ids", pa.list_(pa.string())), ("longest", pa.int64()), ("longest_item", pa.string()), ("longest_at", pa.int64()), ("spans", pa.list_(_SPAN))])


def _search(batches: Iterable[pa.RecordBatch], block: Broadcast, shard_words: int, hits_only: bool = False) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("_text")).cast(pa.binary())
        rest = batch.drop_columns(["_text"])
        docs, begun, n = [], 0, 0
        for i, text in enumerate(texts):
            docs.append(words_of(text.as_py()))
            n += len(docs[-1])
            if n >= shard_words or i == len(texts) - 1:
                rows = pa.RecordBatch.from_pylist(_shard_rows(docs, block.value), schema=_ADDED)
                part = rest.slice(begun, len(docs))
                out = pa.RecordBatch.from_arrays([*part.columns, *rows.columns], schema=pa.schema([*part.schema, *rows.schema]))
                yield out.filter(pc.greater(out.column("n_hit"), 0)) if hits_only else out
                docs, begun, n = [], i + 1, 0


def dealt(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """The benchmark (item_id, text) as distinct items with the block each is in, and how many blocks of about block_bytes of text there are.

    Repeated items count once, so that they don't fill a block.  Items with null or wordless text have no
    window.  No items give one block without any.
    """
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text")).where("text is not null").distinct()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // block_bytes))
    items = rows.withColumn("_block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    # sorted by block, so that reading one skips the row groups of others
    return (items if n == 1 else stage(items.repartitionByRange("_block").sortWithinPartitions("_block"), "contamination-items")), n


def test_block(items: DataFrame, number: int, window: int = WINDOW) -> Broadcast:
    """Block `number` of dealt items as a broadcast; the driver holds its items, block_bytes or so, and no other's."""
    held = [(r.item_id, bytes(r.text)) for r in items.where(F.col("_block") == number).collect()]
    return items.sparkSession.sparkContext.broadcast(Block(held, window))


def _merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with what several blocks found, as lists of it, to one row each."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            spans: list[dict] = []
            for s in sorted((s for f in row["found"] for s in f["spans"]), key=lambda s: s["start"]):
                if spans and s["start"] <= spans[-1]["end"]:
                    spans[-1]["end"] = max(spans[-1]["end"], s["end"])
                else:
                    spans.append(dict(s))
            best = max(row["found"], key=lambda f: f["longest"])
            out.append({"_row": row["_row"], "n_hit": sum(s["end"] - s["start"] for s in spans), "item_ids": sorted({x for f in row["found"] for x in f["item_ids"]}), **{k: best[k] for k in ("longest", "longest_item", "longest_at")}, "spans": spans})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("_row", pa.int64()), *list(_ADDED)[1:]]))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, shard_words: int = _SHARD_WORDS) -> DataFrame:
    """docs with text -> its other columns and, per row, what it shares with the benchmark.

    n_words; n_hit (words inside any occurrence of an item's window: `window` consecutive words, or the whole
    of a shorter item); item_ids (of items with such windows, sorted as strings); longest, longest_item and
    longest_at (the longest verbatim match found, in words, whose it is and at which word it starts); spans (of
    hit words).  Null text has no words.  Items with a null id count in n_hit and have no id to list.  Repeated
    rows stay, no rows give none, and other columns named like these are an error.
    """
    taken = {"_text", "_row", *(x.split()[0] for x in _OUT.split(", "))}
    rest = [c for c in docs.columns if c != "text"]
    if clash := taken & {c.lower() for c in rest}:
        raise ValueError(f"columns named {sorted(clash)}: rename them first")
    texts = docs.select(*rest, F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    declared = lambda df: [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "_text"]
    items, n = dealt(benchmark, block_bytes)
    if n == 1:
        block = test_block(items, 0, window)
        return texts.mapInArrow(partial(_search, block=block, shard_words=shard_words), ", ".join([*declared(texts), _OUT]))
    rows = stage(texts.withColumn("_row", F.monotonically_increasing_id()), "contamination-rows")
    names, found = [x.split()[0] for x in _OUT.split(", ")], None
    for number in range(n):
        block = test_block(items, number, window)
        part = rows.select("_row", "_text").mapInArrow(partial(_search, block=block, shard_words=shard_words, hits_only=True), f"_row long, {_OUT}")
        part = stage(part, "contamination-hits")
        found = part if found is None else found.unionByName(part)
        block.destroy()
    lists = found.groupBy("_row").agg(F.collect_list(F.struct(*names[1:])).alias("found"))  # an entry for each block at most
    merged = stage(lists.mapInArrow(_merged, "_row long, " + _OUT.split(", ", 1)[1]), "contamination-merged")
    counted = rows.select("*", F.size(F.filter(F.split(F.regexp_replace("_text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " "), " "), lambda w: w != "")).cast("long").alias("n_words")).drop("_text")
    joined = counted.join(merged, "_row", "left")
    none = {"n_hit": F.lit(0).cast("long"), "longest": F.lit(0).cast("long"), "item_ids": F.array().cast("array<string>"), "spans": F.array().cast(dict(merged.dtypes)["spans"])}
    return joined.select(*rest, *(F.coalesce(n, none[n]).alias(n) if n in none else n for n in names))


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any benchmark window, in their own columns."""
    packed = docs.select(F.struct(*docs.columns).alias("row"), "text")
    found = contamination(packed, benchmark, **options)
    return found.where("n_hit = 0").select("row.*")
