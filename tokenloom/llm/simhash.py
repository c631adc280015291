"""SimHash near duplicates through an inverted index on byte positions.

A fingerprint of 64 bits is eight positional bytes.  Two fingerprints that differ in at most four
bits differ in at most four bytes, so at least four positional bytes are shared: that is the
guaranteed count.  Candidates come from posting lists, the bytes that a pair shares are tallied, pairs
below the count are dropped and the rest alone are verified bit by bit, each in the first list it is in.

A posting list of one byte holds 1/256 of any corpus, so tallying over single bytes would look at
N*N/32 pairs.  The lists here are keyed by three positional bytes: of the 56 triples of positions, 20 are
enough for every set of four positions to contain one (`TRIPLES`), so a pair with the guaranteed count
meets in at least one list and the tally starts from three shared bytes.

A list of over `cap` fingerprints is never compared as it is.  Its remaining bits are cut into five
groups; two members at four bits or fewer agree on one whole group (pigeonhole), so the list splits into
five sets of smaller ones without losing a link, again and again while lists are too long.  Distinct
fingerprints alone are indexed; exact copies share one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import keep_last, stage, staged_paths, whole_text
from tokenloom.llm.components import components

SEED = 42
SHINGLE = 4
MAX_BITS = 4
MIN_BYTES = 4
LIST_CAP = 2048
_FP = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _triples() -> list[tuple[int, ...]]:
    """Positions in classes 0, 1 and 2 (p % 3): whole classes, and two of a class with one of the next."""
    kept = []
    for three in combinations(range(8), 3):
        classes = [p % 3 for p in three]
        for c in range(3):
            if classes.count(c) == 3 or classes.count(c) == 2 and classes.count((c + 1) % 3) == 1:
                kept.append(three)
    return kept


TRIPLES = _triples()
MASKS = [sum(0xFF << (8 * p) for p in three) for three in TRIPLES]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def finer(mask: int) -> list[int]:
    """The mask with each of five groups of its unset bits added."""
    free = [b for b in range(64) if not mask >> b & 1]
    groups = [free[i * len(free) // (MAX_BITS + 1) : (i + 1) * len(free) // (MAX_BITS + 1)] for i in range(MAX_BITS + 1)]
    return [mask | sum(1 << b for b in group) for group in groups]


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED, block: int = 1 << 16) -> int:
    """SimHash of the word shingles of a UTF-8 text, A-Z lower-cased; 0 where there is no word."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    width = min(shingle, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    digest = partial(xxhash.xxh64_intdigest, seed=seed)
    for at in range(0, len(starts), block):
        cut = map(joined.__getitem__, map(slice, starts[at : at + block], ends[at : at + block]))
        hashes = np.fromiter(map(digest, cut), np.uint64, len(starts[at : at + block]))
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts), bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterable[pa.RecordBatch], shingle: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        fps = np.array([fingerprint(t.as_py(), shingle, seed) for t in texts], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], schema=_FP)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, text) -> (doc_id, fp long) of whole texts.  Null text counts as empty and gives 0."""
    texts = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    return texts.mapInArrow(partial(_fingerprints, shingle=shingle, seed=seed), "doc_id long, fp long")


#: For each set of shared positions (a bit for each), the number of the first triple in it; none: -1.
FIRST = np.array([next((i for i, three in enumerate(TRIPLES) if all(shared >> p & 1 for p in three)), -1) for shared in range(256)], np.int8)
_LIST = {mask: i for i, mask in enumerate(MASKS)}


def tallied(apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of some pairs, given as the XOR of their fingerprints, share MIN_BYTES positional bytes or more, and which positions these share."""
    same = np.packbits(apart.view(np.uint8).reshape(-1, 8) == 0, axis=1, bitorder="little").ravel()
    kept = np.flatnonzero(np.bitwise_count(same) >= MIN_BYTES)
    return kept, same[kept]


def _near(apart: np.ndarray, own: int | None) -> np.ndarray:
    """The pairs of posting list `own` that link: by their tally, then bit by bit, each in the first list that holds both."""
    kept, same = tallied(apart)
    if own is not None:
        kept = kept[FIRST[same] == own]
    return kept[np.bitwise_count(apart[kept]) <= MAX_BITS]


def _star(fps: np.ndarray, own: int | None = None) -> tuple[list[int], list[int]]:
    """Edges from each linked member of a posting list to the member its group was found from.

    own: the list's triple, where a pair is left to the first list that both are in; None for split lists.
    """
    rest, us, vs = fps, [], []
    while len(rest) > 1:
        root, todo, rest = rest[0], [rest[0]], rest[1:]
        while todo and len(rest):
            near = _near(rest ^ todo.pop(), own)
            if len(near):
                found, rest = rest[near], np.delete(rest, near)
                todo.extend(found)
                us.extend(found.tolist())
                vs.extend([root] * len(found))
    return us, vs


def _link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posting lists, sorted by (mask, key), to edges; a list may run over several batches."""
    held = None

    def edges(mask, key, fp):
        cuts = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(fp)]))
        long = ends - starts > 1
        us, vs = [], []
        for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            more = _star(fp[a:b], _LIST.get(int(mask[a]) & (1 << 64) - 1))
            us += more[0]
            vs += more[1]
        out = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (us, vs)]
        return pa.RecordBatch.from_arrays(out, schema=_EDGES)

    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        now[2] = now[2].view(np.uint64)
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        last = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1])) if len(now[0]) else []
        cut = last[-1] + 1 if len(last) else 0
        held = [x[cut:] for x in now]
        if cut:
            yield edges(*(x[:cut] for x in now))
    if held is not None and len(held[0]):
        yield edges(*held)


def _postings(fps: DataFrame, masks: list[int]) -> DataFrame:
    lists = [F.struct(F.lit(_signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for m in masks]
    return fps.select(F.explode(F.array(*lists)).alias("x"), "fp").select("x.mask", "x.key", "fp")


def _refined(postings: DataFrame, masks: list[int]) -> DataFrame:
    """Each posting once for each finer mask of its own."""
    table = postings.sparkSession.createDataFrame([(_signed(m), _signed(f)) for m in masks for f in finer(m)], "mask long, finer long")
    wider = postings.join(F.broadcast(table), "mask")  # 5 rows for each of the masks in use, at most 20 * 5 ** level
    return wider.select(F.col("finer").alias("mask"), F.col("fp").bitwiseAND(F.col("finer")).alias("key"), "fp")


def links(fps: DataFrame, cap: int = LIST_CAP) -> DataFrame:
    """Distinct fingerprints (fp) -> staged edges (u, v) that connect all that differ in 4 bits or fewer.

    Edges are stars inside a posting list: the connected components equal those of all linked pairs, and
    a list of n members gives fewer than n edges.
    """
    if cap < 1 << MAX_BITS + 2:
        raise ValueError("cap: at least 64, else a list can't be split any further")
    masks, found = MASKS, None
    postings = _postings(fps, masks)
    while True:
        sizes = postings.groupBy("mask", "key").count()
        hot = stage(sizes.where(F.col("count") > cap).select("mask", "key"), "simhash-hot")
        used = [r[0] for r in hot.select("mask").distinct().collect()]  # bounded by the masks of this level
        cold = postings.join(hot, ["mask", "key"], "left_anti") if used else postings
        edges = stage(cold.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp").mapInArrow(_link, "u long, v long"), "simhash-edges")
        found = edges if found is None else found.unionByName(edges)
        if not used:
            return found
        unsigned = [m & (1 << 64) - 1 for m in used]
        postings = stage(_refined(postings.join(hot, ["mask", "key"], "left_semi"), unsigned).distinct(), "simhash-finer")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, cap: int = LIST_CAP) -> DataFrame:
    """(doc_id, text) -> (doc_id, fp, component_id), one row per input row.

    component_id is the smallest doc_id reachable over links of 4 differing bits or fewer, the row's own
    included; ids are cast to long.  Null and wordless texts have fingerprint 0 and link like any other.  Repeated rows stay.  A
    null doc_id keeps its row and never names a component (null where its whole component has none).
    """
    fps = stage(fingerprints(docs, shingle, seed), "simhash-fp")
    since = len(staged_paths())
    own = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = stage(components(links(own.select("fp"), cap)), "simhash-roots")
    linked = own.join(roots, own.fp == roots.node)
    named = stage(linked.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-names")
    moved = roots.join(named, "root").select(F.col("node").alias("fp"), "component_id")
    names = own.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    names = stage(names, "simhash-ids")
    keep_last(docs.sparkSession, since)
    return fps.join(names, "fp").select("doc_id", "fp", "component_id")


def kept_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents less all but one of each component: the row whose doc_id names it.

    Of rows that repeat such a doc_id one is kept.  Documents with a null doc_id are kept: without an id
    they can't be told apart, and nothing is dropped for that.
    """
    marked = near_duplicates(docs, **options)
    kept = stage(marked.where("doc_id = component_id").groupBy("doc_id").count(), "simhash-kept")
    once = docs.join(kept.where("count = 1").hint("shuffle_hash"), "doc_id", "left_semi")
    again = docs.join(kept.where("count > 1"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return once.unionByName(again).unionByName(docs.where(F.col("doc_id").isNull()))
