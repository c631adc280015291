"""JSON texts as relations: tokens, values, pointer events, verdicts, and texts with values taken out or masked.

The JVM's regular expressions cut each text into literals (inside whole-stage codegen, next to the scan);
Arrow batches of literals then get their columns from `plans.analysis`.  Nothing is shuffled, columns that
nobody asks for are not made, and a task holds one batch of texts.

A text that is STRING is lexed by the JVM.  A text that is BINARY may break UTF-8 inside strings; rows that
do are lexed over their bytes in the task.  Null texts give no rows (verdicts: a null one).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.pointers import Group
from tokenloom.plans.analysis import WHITE, Tokens
from tokenloom.plans.grammar import EXPECTATIONS, KINDS, TOKEN, TOKEN_BYTES, WHOLE_BYTES

MAX_LEVEL = 128
POSITION = "struct<offset:long,line:long,col:long>"
ERROR = f"struct<class:string,variant:string,token:string,expect:string,actual:int,first:int,second:int,seq_len:int,byte_no:int,level:int,stack:array<string>,token_pos:{POSITION},err_pos:{POSITION},message:string>"
_POS = pa.struct([(n, pa.int64()) for n in ("offset", "line", "col")])
_ERR = pa.struct([(n, pa.string()) for n in ("class", "variant", "token", "expect")] + [(n, pa.int32()) for n in ("actual", "first", "second", "seq_len", "byte_no", "level")] + [("stack", pa.list_(pa.string())), ("token_pos", _POS), ("err_pos", _POS), ("message", pa.string())])
TOKEN_COLUMNS = {"i": "long", "kind": "string", "literal": "string", "is_escaped": "boolean", "offset": "long", "line": "long", "col": "long", "level": "long", "expect": "string", "inside": "string", "stack": "array<string>", "struct_i": "long", "struct_end_i": "long", "closes_i": "long", "text_no": "long", "err": ERROR}
_STACK = pa.list_(pa.string())
#: Kinds that mean nothing by themselves.
SEPARATORS = ("White", "NameSep", "ValueSep")


def lexed(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the text replaced by _literals (array of strings) and _raw.

    _raw holds bytes only where they aren't UTF-8; _literals is null there.
    """
    own = F.col(text).cast("string")
    found, raw = F.regexp_extract_all(own, F.lit(f"({TOKEN})"), F.lit(0)), F.lit(None).cast("binary")
    if dict(docs.dtypes)[text] == "binary":
        found, raw = F.when(F.is_valid_utf8(own), found), F.when(~F.is_valid_utf8(own), F.col(text))
    rest = (f"`{c}`" for c in docs.columns if c != text)
    return docs.where(F.col(text).isNotNull()).select(*rest, found.alias("_literals"), raw.alias("_raw"))


class Batch:
    """An Arrow batch of lexed texts: its other columns and its tokens."""

    def __init__(self, batch: pa.RecordBatch, level: int, many: bool):
        names = batch.schema.names
        column = lambda n: batch.column(names.index(n))
        self.rest = batch.select([n for n in names if n not in ("_literals", "_raw")])
        lists, raw = column("_literals"), column("_raw")
        if raw.null_count < len(raw):
            rows = [TOKEN_BYTES.findall(data.as_py()) if data.is_valid else [x.encode() for x in own] for data, own in zip(raw, lists.to_pylist(), strict=True)]
            lists = pa.array(rows, pa.list_(pa.binary()))
        flat = lists.flatten().cast(pa.binary())
        counts = np.array(lists.value_lengths().fill_null(0), np.int64)
        last = np.cumsum(counts) - 1  # an error can only be a text's last token
        bad = [n > 0 and WHOLE_BYTES.fullmatch(flat[i].as_py()) is None for i, n in zip(last.tolist(), counts.tolist(), strict=True)]
        self.tokens = Tokens(flat, counts, np.array(bad, bool), level, many)

    def rows(self, docs: np.ndarray, columns: dict[str, pa.Array]) -> pa.RecordBatch:
        """The rest of each of docs beside columns."""
        kept = self.rest.take(pa.array(docs)) if len(self.rest.schema) else self.rest
        return pa.RecordBatch.from_arrays([*kept.columns, *columns.values()], [*kept.schema.names, *columns])


def _apply(batches: Iterable[pa.RecordBatch], make: Callable[[Batch], pa.RecordBatch], level: int, many: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield make(Batch(batch, level, many))


def _run(docs: DataFrame, text: str, make: Callable[[Batch], pa.RecordBatch], columns: dict[str, str], level: int = MAX_LEVEL, many: bool = False) -> DataFrame:
    rest = [f for f in docs.schema if f.name != text]
    if clash := {f.name.lower() for f in rest} & {*columns, "_literals", "_raw"}:
        raise ValueError(f"columns named {sorted(clash)}: rename them first")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), *(f"`{n}` {t}" for n, t in columns.items())])
    return lexed(docs, text).mapInArrow(partial(_apply, make=make, level=level, many=many), schema)


def _text(t: Tokens, index: np.ndarray) -> pa.Array:
    """Literals as strings; an error's bytes that aren't UTF-8 are replaced."""
    try:
        return t.literals.take(pa.array(index)).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([t.literal(i).decode("utf-8", "replace") for i in index.tolist()], pa.string())


def _ints(values: np.ndarray, where: np.ndarray | None = None) -> pa.Array:
    """Whole numbers, null but where."""
    return pa.array(values.astype(np.int64), pa.int64(), mask=None if where is None else ~where)


def _names(codes: np.ndarray, names: tuple[str, ...], where: np.ndarray | None = None) -> pa.Array:
    return pa.array(names, pa.string()).take(pa.array(codes.astype(np.int32), mask=None if where is None else ~where))


def _nulls(n: int, kind: pa.DataType) -> pa.Array:
    return pa.nulls(n, kind)


class Context:
    """Columns of the tokens `at` and of the ends (Eof or Err) of the texts `ended`, in the order of texts and tokens."""

    def __init__(self, b: Batch, at: np.ndarray, ended: np.ndarray, stop: np.ndarray, failed: np.ndarray):
        self.t, self.at, self.ended, self.stop, self.failed = b.tokens, at, ended, stop, failed[ended]
        t = self.t
        self.place = t.index - t.first[t.doc] if t.n else t.index
        docs, i = np.concatenate((t.doc[at], ended)), np.concatenate((self.place[at], stop[ended]))
        order = np.lexsort((i, docs)) if len(ended) else np.arange(len(docs))
        self.docs, self.order = docs[order], pa.array(order) if len(ended) else None

    @cached_property
    def errors(self) -> list[dict]:
        return self.t.errors(self.ended[self.failed], self.stop)

    def _put(self, real: pa.Array, last: Callable[[], pa.Array]) -> pa.Array:
        return real if self.order is None else pa.concat_arrays([real, last()]).take(self.order)

    def _last(self, ends: Callable[[], pa.Array] | None, of: Callable[[dict], object], kind: pa.DataType) -> pa.Array:
        """For each ended text `of` its error, else its value in ends (null if there is none)."""
        if not self.failed.any():
            return ends() if ends else _nulls(len(self.ended), kind)
        bad = pa.array([of(e) for e in self.errors], kind)
        good = ends() if ends else _nulls(len(self.ended), kind)
        return pa.concat_arrays([good, bad]).take(pa.array(np.where(self.failed, len(good) + np.cumsum(self.failed) - 1, np.arange(len(good)))))

    @cached_property
    def _end(self) -> tuple[np.ndarray, ...]:
        """Offset, line and column of the texts' ends."""
        t = self.t
        base, end = t.edge[t.first[self.ended]], t.edge[t.first[self.ended] + t.counts[self.ended]]
        return (end - base, *t._lines(base, end))

    def made(self, names: list[str]) -> dict[str, pa.Array]:
        t, at, text, long = self.t, self.at, pa.string(), pa.int64()
        box = t.inside[at] if {"inside", "struct_i", "struct_end_i"} & set(names) else at
        none = np.zeros(len(self.ended), np.int64)
        put, last = self._put, self._last

        def literals() -> pa.Array:
            first = t.first[self.ended] + self.stop[self.ended]
            inside = self.stop[self.ended] < t.counts[self.ended]
            return pa.array([t.literal(i).decode("utf-8", "replace") if x else "" for i, x in zip(first.tolist(), inside.tolist(), strict=True)], text)

        def escaped() -> pa.Array:
            return pc.and_(pa.array(t.kind[at] == KINDS.index("Str")), pc.match_substring(t.literals.take(pa.array(at)).cast(pa.binary()), "\\"))

        def texts_before() -> np.ndarray:
            done = np.concatenate(([0], np.cumsum(t.value_ends & (t.leaves < 0)))) if t.n else np.zeros(1, np.int64)
            return done[t.first[self.ended] + self.stop[self.ended]] - done[t.first[self.ended]]

        def shut() -> tuple[np.ndarray, np.ndarray]:
            ends = np.where(box >= 0, t.closer[box], -1)
            return self.place[ends], ends >= 0

        columns = {
            "i": lambda: put(_ints(self.place[at]), lambda: _ints(self.stop[self.ended])),
            "kind": lambda: put(_names(t.kind[at], KINDS), lambda: _names(np.where(self.failed, KINDS.index("Err"), KINDS.index("Eof")), KINDS)),
            "literal": lambda: put(_text(t, at), literals),
            "is_escaped": lambda: put(escaped(), lambda: pa.array(np.zeros(len(self.ended), bool))),
            "offset": lambda: put(_ints(t.offset[at]), lambda: last(lambda: _ints(self._end[0]), lambda e: e["token_pos"]["offset"], long)),
            "line": lambda: put(_ints(t.position[0][at]), lambda: last(lambda: _ints(self._end[1]), lambda e: e["token_pos"]["line"], long)),
            "col": lambda: put(_ints(t.position[1][at]), lambda: last(lambda: _ints(self._end[2]), lambda e: e["token_pos"]["col"], long)),
            "level": lambda: put(_ints(t.level[at]), lambda: last(lambda: _ints(none), lambda e: len(e["stack"]), long)),
            "expect": lambda: put(_names(t.expect[at], EXPECTATIONS), lambda: last(lambda: pa.array(["Eof"] * len(none), text), lambda e: e.get("expect"), text)),
            "inside": lambda: put(_names(t.kind[box] == KINDS.index("ObjBegin"), ("Arr", "Obj"), box >= 0), lambda: last(None, lambda e: (e["stack"] or [None])[-1], text)),
            "stack": lambda: put(t.stacks(t.leaves[at])[1], lambda: last(lambda: pa.array([[]] * len(none), _STACK), lambda e: e["stack"], _STACK)),
            "struct_i": lambda: put(_ints(self.place[box], box >= 0), lambda: _nulls(len(none), long)),
            "struct_end_i": lambda: put(_ints(*shut()), lambda: _nulls(len(none), long)),
            "closes_i": lambda: put(_ints(self.place[t.closer[at]], t.closer[at] >= 0), lambda: _nulls(len(none), long)),
            "text_no": lambda: put(_ints(t.text_no[at]), lambda: _ints(texts_before())),
            "err": lambda: put(_nulls(len(at), _ERR), lambda: last(None, lambda e: e, _ERR)),
        }
        return {n: columns[n]() for n in names}


def _skipped(t: Tokens, after: int) -> np.ndarray:
    """Tokens between token `after` of their text and the end of the structure it stands in."""
    if not t.n:
        return np.zeros(0, bool)
    has = t.counts > after
    here = np.minimum(t.first + after, t.n - 1)
    opens = np.isin(t.kind[here], (KINDS.index("ArrBegin"), KINDS.index("ObjBegin")))
    box = np.where(opens, here, t.inside[here])
    to = np.where(box >= 0, t.closer[box], t.n)
    to = np.where(has, np.where(to >= 0, to, t.n), -1)  # left open: to the text's end
    return (t.index > (t.first + after)[t.doc]) & (t.index < to[t.doc])


def _tokens(b: Batch, names: list[str], syntax: bool, eof: bool, skip: tuple[str, ...], after: int | None) -> pa.RecordBatch:
    t = b.tokens
    stop, failed = t.stops(syntax)
    shown = t.index - t.first[t.doc] < stop[t.doc] if t.n else np.zeros(0, bool)
    if skip:
        shown &= ~np.isin(t.kind, [KINDS.index(k) for k in skip])
    if after is not None:
        shown &= ~_skipped(t, after)
    own = Context(b, np.flatnonzero(shown), np.flatnonzero(failed | eof), stop, failed)
    return b.rows(own.docs, own.made(names))


def tokenize(docs: DataFrame, text: str = "text", columns: list[str] | None = None, syntax: bool = False, max_level: int = MAX_LEVEL, many: bool = False, eof: bool = True, skip: tuple[str, ...] = (), after: int | None = None) -> DataFrame:
    """A row per token: docs' other columns and those of TOKEN_COLUMNS asked for (all by default).

    syntax: hold tokens against the grammar, to nesting max_level (without it only lexical errors end a text).
    many: texts hold any number of values one behind the other, numbered by text_no.  eof: end each text with an
    Eof row.  skip: kinds to leave out.  after: leave out what `skip_structure` does behind that token.  The
    first error of a text is its last row, of kind Err, with err.
    offset counts bytes from 0, line and col from 1 in characters; level is the nesting behind the token and
    stack the kinds of what is open there; inside, struct_i and struct_end_i tell which structure it stands in (a
    closing bracket: its own) and from where to where that goes; closes_i tells where what a bracket opens ends
    (any other token: itself).  Joined in order, the literals of a text without error are the text.
    """
    names = columns or list(TOKEN_COLUMNS)
    if max_level < 0:
        raise ValueError("max_level: 0 or more")
    return _run(docs, text, partial(_tokens, names=names, syntax=syntax, eof=eof, skip=tuple(skip), after=after), {n: TOKEN_COLUMNS[n] for n in names}, max_level, many)


def parse(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """tokenize, held against the grammar."""
    return tokenize(docs, text, syntax=True, **options)


def non_white(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """Validated tokens without white space."""
    return parse(docs, text, skip=("White",), **options)


def meaningful(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """Validated tokens without white space and separators."""
    return parse(docs, text, skip=SEPARATORS, **options)


def skip_structure(docs: DataFrame, at: int, text: str = "text", **options) -> DataFrame:
    """Validated tokens less those between token `at` of each text and the end of the structure it stands in.

    The closing bracket stays; at the top level, the Eof (or the error).  An opening bracket stands in what
    it opens.  A structure left open ends with its text.  Texts of fewer tokens lose none.
    """
    return parse(docs, text, after=at, **options)


_VERDICTS = {"is_valid": "boolean", "n_tokens": "long", "max_level": "long", "err": ERROR}


def _verdicts(b: Batch, names: list[str]) -> pa.RecordBatch:
    t = b.tokens
    stop, failed = t.stops()

    def deepest() -> pa.Array:
        out = np.zeros(len(t.counts), np.int64)
        if t.n:
            some = np.flatnonzero(t.counts)
            out[some] = np.maximum.reduceat(np.where(t.index - t.first[t.doc] < stop[t.doc], t.level, 0), t.first[some])
        return pa.array(out)

    def errors() -> pa.Array:
        docs = np.flatnonzero(failed)
        found = pa.array(t.errors(docs, stop), _ERR)
        where = np.zeros(len(failed), np.int64)
        where[docs] = np.arange(len(docs))
        return found.take(pa.array(where, mask=~failed))

    columns = {"is_valid": lambda: pa.array(~failed), "n_tokens": lambda: pa.array(stop), "max_level": deepest, "err": errors}
    return b.rows(np.arange(len(t.counts)), {n: columns[n]() for n in names})


def _asked(columns: list[str] | None, there: dict[str, str]) -> dict[str, str]:
    return {n: there[n] for n in columns} if columns else there


def validate(docs: DataFrame, text: str = "text", max_level: int = MAX_LEVEL, many: bool = False, columns: list[str] | None = None) -> DataFrame:
    """A row per text: is_valid, n_tokens (before the error), max_level reached and err, its first error, or those asked for."""
    names = _asked(columns, _VERDICTS)
    return _run(docs, text, partial(_verdicts, names=list(names)), names, max_level, many)


_VALUE_COLUMNS = {"i": "long", "end_i": "long", "parent_i": "long", "depth": "long", "kind": "string", "name": "string", "idx": "long", "literal": "string"}


def _values(b: Batch, names: list[str]) -> pa.RecordBatch:
    t = b.tokens
    stop, _ = t.stops()
    place = t.index - t.first[t.doc] if t.n else t.index
    at = np.flatnonzero(t.is_value & (place < stop[t.doc])) if t.n else t.index
    box = t.inside[at]
    member = (box >= 0) & (t.kind[box] == KINDS.index("ObjBegin"))
    element = (box >= 0) & ~member
    primitive = ~np.isin(t.kind[at], (KINDS.index("ArrBegin"), KINDS.index("ObjBegin")))

    def spread(some: pa.Array, where: np.ndarray) -> pa.Array:
        """The values of some where, in order, null elsewhere."""
        return some.take(pa.array(np.maximum(np.cumsum(where) - 1, 0), mask=~where)) if len(some) else _nulls(len(where), some.type)

    columns = {
        "i": lambda: _ints(place[at]),
        "end_i": lambda: _ints(place[t.closer[at]], t.closer[at] >= 0),
        "parent_i": lambda: _ints(place[box], box >= 0),
        "depth": lambda: _ints(t.before[at] if t.n else at),
        "kind": lambda: _names(t.kind[at], KINDS),
        "name": lambda: spread(pc.utf8_slice_codeunits(_text(t, t.names_of(at[member])), 1, -1), member),
        "idx": lambda: spread(_ints(t.places_of(at[element])), element),
        "literal": lambda: spread(_text(t, at[primitive]), primitive),
    }
    return b.rows(t.doc[at], {n: columns[n]() for n in names})


def values(docs: DataFrame, text: str = "text", max_level: int = MAX_LEVEL, many: bool = False, columns: list[str] | None = None) -> DataFrame:
    """A row per value: where it begins and ends, its parent, depth, member name (as written) or array index, literal, or those asked for."""
    names = _asked(columns, _VALUE_COLUMNS)
    return _run(docs, text, partial(_values, names=list(names)), names, max_level, many)


_COUNTED = {"name": "string", "depth": "long", "n": "long"}


def _member_counts(b: Batch) -> pa.RecordBatch:
    t = b.tokens
    stop, _ = t.stops()
    at = np.flatnonzero(t.is_value & (t.index - t.first[t.doc] < stop[t.doc]) & (t.inside >= 0)) if t.n else t.index
    at = at[t.kind[t.inside[at]] == KINDS.index("ObjBegin")]
    if not len(at):
        return b.rows(at, {n: _nulls(0, pa.string() if n == "name" else pa.int64()) for n in _COUNTED})
    names = pc.utf8_slice_codeunits(_text(t, t.names_of(at)), 1, -1).dictionary_encode()
    depth = t.before[at]
    keys = (t.doc[at] * len(names.dictionary) + names.indices.to_numpy()) * (int(depth.max()) + 1) + depth
    _, one, n = np.unique(keys, return_index=True, return_counts=True)
    return b.rows(t.doc[at[one]], {"name": names.dictionary.take(names.indices.take(pa.array(one))), "depth": _ints(depth[one]), "n": _ints(n)})


def member_counts(docs: DataFrame, text: str = "text", max_level: int = MAX_LEVEL, many: bool = False) -> DataFrame:
    """A row per text, name (as written) and depth of its members: how many values so named it has there before its first error.

    A text lies in one batch whole, so it is counted there: grouping the rows of `values` would hold the groups
    of all texts of a task at once.  Texts whose other columns are alike are counted one by one.
    """
    return _run(docs, text, _member_counts, _COUNTED, max_level, many)


def _hits(b: Batch, group: Group) -> tuple[Tokens, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    t = b.tokens
    stop, failed = t.stops()
    state = t.states(group, stop)
    named = np.array([p is not None for p in group.pointer_at])
    hit = (state >= 0) & named[np.maximum(state, 0)]
    return t, state, hit, stop, failed


EVENT_COLUMNS = {"i": "long", "event": "string", "kind": "string", "pointer": "string", "literal": "string", "level": "long"} | {n: k for n, k in TOKEN_COLUMNS.items() if n in ("offset", "line", "col", "inside", "stack", "text_no", "err")}
_EVENTS = ("Nil", "Match", "Enter", "Exit")


def _events(b: Batch, group: Group, nil: bool, names: list[str], skip: tuple[str, ...], after: int | None) -> pa.RecordBatch:
    t, state, hit, stop, failed = _hits(b, group)
    shown = t.index - t.first[t.doc] < stop[t.doc] if nil and t.n else hit
    if skip:
        shown = shown & ~np.isin(t.kind, [KINDS.index(k) for k in skip])
    if after is not None:
        shown = shown & ~_skipped(t, after)
    at = np.flatnonzero(shown)
    own = Context(b, at, np.flatnonzero(failed & nil), stop, failed)
    code = np.zeros(len(KINDS), np.int64)
    code[[KINDS.index(k) for k in ("LitFalse", "LitNull", "LitTrue", "Num", "Str")]] = 1
    code[[KINDS.index(k) for k in ("ArrBegin", "ObjBegin")]] = 2
    code[[KINDS.index(k) for k in ("ArrEnd", "ObjEnd")]] = 3
    none = np.zeros(len(own.ended), np.int64)
    extra = {
        "event": lambda: own._put(_names(np.where(hit[at], code[t.kind[at]], 0), _EVENTS), lambda: _names(none, _EVENTS)),
        "pointer": lambda: own._put(pa.array(group.pointer_at, pa.string()).take(pa.array(np.maximum(state[at], 0), mask=~hit[at])), lambda: _nulls(len(none), pa.string())),
    }
    made = own.made([n for n in names if n not in extra])
    return b.rows(own.docs, {n: extra[n]() if n in extra else made[n] for n in names})


def pointer_events(docs: DataFrame, pointers: list[str] | Group, text: str = "text", nil: bool = False, max_level: int = MAX_LEVEL, many: bool = False, columns: list[str] | None = None, skip: tuple[str, ...] = (), after: int | None = None, **group) -> DataFrame:
    """A row per event: i, event (Match, Enter, Exit and, if nil, Nil), kind, pointer, literal, level, or columns of EVENT_COLUMNS.

    A primitive that a pointer reaches is a Match; a structure has an Enter and an Exit.  Duplicate names all
    match.  Texts are validated as they are read: events of a text end at its first error (with nil, a Nil
    event of kind Err is the last).  skip: kinds whose events are left out (SEPARATORS: the meaningful ones stay).
    after: events between that token and the end of the structure it stands in are left out, the closing
    bracket's stays.
    """
    group = pointers if isinstance(pointers, Group) else Group(pointers, **group)
    names = _asked(columns or ["i", "event", "kind", "pointer", "literal", "level"], EVENT_COLUMNS)
    return _run(docs, text, partial(_events, group=group, nil=nil, names=list(names), skip=tuple(skip), after=after), names, max_level, many)


def _spans(t: Tokens, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and last tokens of the values reached, those left open out."""
    begins = np.flatnonzero(hit & t.is_value) if t.n else t.index
    ends = t.closer[begins]
    return begins[ends >= 0], ends[ends >= 0]


_EXTRACTED = {"i": "long", "text_no": "long", "pointer": "string", "kind": "string", "value": "string"}


def _cut(t: Tokens, begins: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Values lie in the batch's bytes as they are: bounds of every other piece cut them out."""
    if not len(begins):
        return _nulls(0, pa.string())
    single = begins == ends
    out = t.literals.take(pa.array(begins)).cast(pa.binary())
    if single.all():
        return out.cast(pa.string())
    wide = [t.data[t.edge[a] : t.edge[z + 1]].tobytes() for a, z in zip(begins[~single].tolist(), ends[~single].tolist(), strict=True)]
    return pc.replace_with_mask(out, pa.array(~single), pa.array(wide, pa.binary())).cast(pa.string())


def _extracted(b: Batch, group: Group, names: list[str]) -> pa.RecordBatch:
    t, state, hit, _, _ = _hits(b, group)
    begins, ends = _spans(t, hit)
    none = not len(begins)

    columns = {
        "i": lambda: _ints(begins if none else begins - t.first[t.doc[begins]]),
        "text_no": lambda: _ints(begins if none else t.text_no[begins]),
        "pointer": lambda: pa.array(group.pointer_at, pa.string()).take(pa.array(state[begins])),
        "kind": lambda: _names(t.kind[begins], KINDS),
        "value": lambda: _cut(t, begins, ends),
    }
    return b.rows(t.doc[begins], {n: columns[n]() for n in names})


def extract(docs: DataFrame, pointers: list[str] | Group, text: str = "text", max_level: int = MAX_LEVEL, many: bool = False, columns: list[str] | None = None, **group) -> DataFrame:
    """A row per value that a pointer reaches: i, text_no, pointer, kind and value, its text byte for byte, or those asked for."""
    group = pointers if isinstance(pointers, Group) else Group(pointers, **group)
    names = _asked(columns, _EXTRACTED)
    return _run(docs, text, partial(_extracted, group=group, names=list(names)), names, max_level, many)


def _picked(b: Batch, group: Group, pointers: list[str]) -> pa.RecordBatch:
    t, state, hit, _, _ = _hits(b, group)
    begins, ends = _spans(t, hit)
    n, k = len(t.counts), len(pointers)
    place = np.array([pointers.index(p) if p is not None else -1 for p in group.pointer_at])
    slots, one = np.unique(t.doc[begins] * k + place[state[begins]], return_index=True)  # the first of each
    where = np.full(n * k, -1)
    where[slots] = one
    found = _cut(t, begins, ends).take(pa.array(where, mask=where < 0))
    return b.rows(np.arange(n), {"picked": pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k), pa.int32()), found)})


def picked(docs: DataFrame, pointers: list[str], text: str = "text", max_level: int = MAX_LEVEL, many: bool = False, **group) -> DataFrame:
    """A row per text: picked, an array of the first value that each of pointers reaches there, in their order (null: none).

    For texts whose values are wanted side by side: nothing needs to be grouped by text again.
    """
    return _run(docs, text, partial(_picked, group=Group(pointers, **group), pointers=list(pointers)), {"picked": "array<string>"}, max_level, many)


def _redacted(b: Batch, group: Group, mask: str) -> pa.RecordBatch:
    t, _, hit, _, failed = _hits(b, group)
    begins, ends = _spans(t, hit)
    outer = begins > np.maximum.accumulate(np.concatenate(([-1], ends)))[:-1]  # what lies in a masked value is masked already
    begins, ends = begins[outer], ends[outer]
    edge = np.concatenate((t.edge[t.first], [t.edge[t.n]]))
    # what stays, as pieces: from a text's start or a masked value's end to the next masked value or the text's end
    starts = np.concatenate((t.edge[ends + 1], edge[:-1]))
    order = np.argsort(starts, kind="stable")  # where a masked value ends and a text starts, the value's end comes first
    masked, starts, stops = order < len(ends), starts[order], np.sort(np.concatenate((edge[1:], t.edge[begins])))
    size = stops - starts
    own = np.frombuffer(mask.encode(), np.uint8)
    lead = np.where(masked, len(own), 0)
    upto = np.concatenate(([0], np.cumsum(size + lead)))
    out = np.empty(int(upto[-1]), np.uint8)
    for j in range(len(own)):
        out[upto[:-1][masked] + j] = own[j]
    place = np.arange(int(size.sum())) + np.repeat(starts - (np.cumsum(size) - size), size)
    out[np.arange(int(size.sum())) + np.repeat((upto[:-1] + lead) - (np.cumsum(size) - size), size)] = t.data[place]
    bounds = np.append(upto[:-1][~masked], upto[-1])
    texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(t.counts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out)])
    try:
        texts = texts.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:
        texts = pa.array([x.as_py().decode("utf-8", "replace") for x in texts], pa.string())
    return b.rows(np.arange(len(t.counts)), {"redacted": texts, "is_valid": pa.array(~failed)})


def redact(docs: DataFrame, pointers: list[str] | Group, mask: str = '"***"', text: str = "text", max_level: int = MAX_LEVEL, many: bool = False, **group) -> DataFrame:
    """A row per text: redacted (values that a pointer reaches masked, all else byte for byte) and is_valid.

    A text with an error is masked up to it.
    """
    group = pointers if isinstance(pointers, Group) else Group(pointers, **group)
    return _run(docs, text, partial(_redacted, group=group, mask=mask), {"redacted": "string", "is_valid": "boolean"}, max_level, many)


def _indented(b: Batch, indent: str) -> pa.RecordBatch:
    t = b.tokens
    _, failed = t.stops()
    out = []
    level = t.level
    for d, (f, n) in enumerate(zip(t.first.tolist(), t.counts.tolist(), strict=True)):
        if failed[d]:
            out.append(None)
            continue
        solid = [i for i in range(f, f + n) if t.kind[i] != WHITE]
        parts = []
        for i, after in zip(solid, [*solid[1:], -1], strict=True):
            kind = KINDS[t.kind[i]]
            follows = KINDS[t.kind[after]] if after >= 0 else None
            parts.append(t.literal(i).decode())
            if kind == "NameSep":
                parts.append(" ")
            elif kind == "ValueSep" or kind in ("ArrBegin", "ObjBegin") and follows not in ("ArrEnd", "ObjEnd"):
                parts.append("\n" + indent * int(level[i]))
            elif follows in ("ArrEnd", "ObjEnd") and kind not in ("ArrBegin", "ObjBegin"):
                parts.append("\n" + indent * int(level[after]))
        out.append("".join(parts))
    return b.rows(np.arange(len(t.counts)), {"pretty": pa.array(out, pa.string())})


def pretty(docs: DataFrame, text: str = "text", indent: str = "  ", max_level: int = MAX_LEVEL) -> DataFrame:
    """A row per text: pretty, the text indented anew; null for a text with an error."""
    return _run(docs, text, partial(_indented, indent=indent), {"pretty": "string"}, max_level)

