"""Table functions for SQL: tokens of texts and events of pointers on them, as in

    SELECT * FROM json_tokens(TABLE(SELECT id, text FROM docs))
    SELECT * FROM json_pointer_events(TABLE(SELECT id, text, array('/a', '/b/0') AS pointers FROM docs))

The tables' columns are taken by place, whatever their names.  They are read in Arrow batches where they lie; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

from tokenloom.functions.pointers import Group
from tokenloom.operators.json_texts import EVENT_COLUMNS, MAX_LEVEL, TOKEN_COLUMNS, Batch, _events, _tokens
from tokenloom.plans.grammar import TOKEN_BYTES

_TOKENS = [n for n in TOKEN_COLUMNS if n not in ("err", "stack", "struct_i", "struct_end_i", "closes_i")]
_EVENTS = ["i", "event", "kind", "pointer", "literal", "level"]


def _batch(ids: pa.Array, texts: pa.Array) -> Batch:
    found = pa.array([TOKEN_BYTES.findall(x.as_py()) for x in texts.cast(pa.binary())], pa.list_(pa.binary()))
    return Batch(pa.RecordBatch.from_arrays([ids, found, pa.nulls(len(ids), pa.binary())], ["id", "_literals", "_raw"]), MAX_LEVEL, False)


@lru_cache(64)
def _group(pointers: tuple[str, ...]) -> Group:
    return Group(list(pointers))


def _declared(names: list[str], kinds: dict[str, str]) -> str:
    return ", ".join(["id long", *(f"`{n}` {kinds[n]}" for n in names)])


@arrow_udtf(returnType=_declared(_TOKENS, TOKEN_COLUMNS))
class JsonTokens:
    """(id, text) -> validated tokens of each text, an Eof or Err last.  Null texts have none."""

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = rows.filter(pc.is_valid(rows.column(1)))
        if rows.num_rows:
            yield _tokens(_batch(rows.column(0), rows.column(1)), _TOKENS, True, True, (), None)


@arrow_udtf(returnType=_declared(_EVENTS, EVENT_COLUMNS))
class JsonPointerEvents:
    """(id, text, pointers) -> Match, Enter and Exit events.  Null texts and null arrays have none; null pointers are left out."""

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = rows.filter(pc.and_(pc.is_valid(rows.column(1)), pc.is_valid(rows.column(2))))
        groups: dict[tuple, list[int]] = {}
        for i, pointers in enumerate(rows.column(2).to_pylist()):
            groups.setdefault(tuple(p for p in pointers if p is not None), []).append(i)
        for pointers, mine in groups.items():
            some = rows.take(pa.array(mine))
            yield _events(_batch(some.column(0), some.column(1)), _group(pointers), False, _EVENTS, (), None)


def register(spark: SparkSession) -> None:
    """Make json_tokens and json_pointer_events known to the session's SQL."""
    spark.udtf.register("json_tokens", JsonTokens)
    spark.udtf.register("json_pointer_events", JsonPointerEvents)
