"""Lexing and parsing of chunked texts as they arrive, by Structured Streaming's keyed state.

State of a stream: the next chunk's number, chunks that came early, the bytes of a token still open, the
position, and the parser's stack; of one that has ended or failed, its id alone.  A chunk may end at any byte.

A call of Python and an entry of the state store cost milliseconds, a small text some microseconds: the state's
key is therefore a group of streams, dealt by a hash of their ids.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tokenloom.plans.analysis import _FIRST
from tokenloom.plans.diagnosis import diagnose, message
from tokenloom.plans.grammar import ALLOWED, KINDS, TOKEN_BYTES, WHOLE_BYTES

_STOPS = re.compile(rb'["\\\x00-\x1f\x80-\xff]')
TOKEN_COLUMNS = {"text_no": "long", "i": "long", "kind": "string", "literal": "string", "offset": "long", "line": "long", "col": "long", "level": "long", "message": "string"}


class Progress:
    """What a stream has come to."""

    def __init__(self):
        self.next, self.early, self.tail, self.ended, self.failed = 0, {}, b"", False, False
        self.i, self.offset, self.line, self.col, self.text_no = 0, 0, 1, 1, 0
        self.stack, self.expect = [], "Value"

    def accept(self, kind: str, many: bool, max_level: int) -> dict | None:
        """Take a token; the error it is, if it is one."""
        if kind == "White":
            return None
        expect = "Value" if many and self.expect == "Eof" and kind != "Eof" else self.expect
        if kind not in ALLOWED[expect] and not (kind == "Eof" and many and expect == "Value" and not self.stack and self.fresh):
            return {"class": "syntax", "expect": expect, "token": kind}
        if kind in ("ArrBegin", "ObjBegin"):
            if len(self.stack) == max_level:
                return {"class": "level", "level": max_level + 1, "token": kind}
            self.stack.append(kind[:3])
            self.expect = "ArrElementOrEnd" if kind == "ArrBegin" else "ObjNameOrEnd"
        elif kind == "NameSep":
            self.expect = "Value"
        elif kind == "ValueSep":
            self.expect = "Value" if self.stack[-1] == "Arr" else "ObjName"
        elif kind == "Str" and expect in ("ObjName", "ObjNameOrEnd"):
            self.expect = "ObjNameSep"
        elif kind != "Eof":
            if kind in ("ArrEnd", "ObjEnd"):
                self.stack.pop()
            self.expect = {"Arr": "ArrElementSepOrEnd", "Obj": "ObjValueSepOrEnd"}[self.stack[-1]] if self.stack else "Eof"
        return None

    @property
    def fresh(self) -> bool:
        """Nothing of a text was read yet."""
        return self.expect == "Value" and not self.stack

    def move(self, kind: str, literal: bytes, text: str) -> None:
        self.offset += len(literal)
        if kind != "White" or b"\n" not in literal and b"\r" not in literal:
            self.col += len(text)
            return
        lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        self.line += len(lines) - 1
        self.col = len(lines[-1]) + (self.col if len(lines) == 1 else 1)


def _open(token: bytes) -> bool:
    """More bytes may still change a token that stands last."""
    if WHOLE_BYTES.fullmatch(token):
        return token[0] not in b'"{}[]:,'
    return diagnose(token)["variant"] == "UnexpectedEof"


def _advance(p: Progress, many: bool, max_level: int) -> list[tuple]:
    """Rows of TOKEN_COLUMNS for the tokens that are whole."""
    out = []

    def put(kind: str, literal: bytes, error: dict | None = None) -> str:
        said = None
        if error:
            said, kind, p.failed = message(error | {"token_pos": {"offset": p.offset, "line": p.line, "col": p.col}}), "Err", True
        text = literal.decode("utf-8", "replace")
        out.append((p.text_no, p.i, kind, text, p.offset, p.line, p.col, len(p.stack), said))
        p.i += 1
        return text

    tokens = TOKEN_BYTES.findall(p.tail)
    held, wrong = b"", None
    if tokens and not p.ended and _open(tokens[-1]):
        held = tokens.pop()
    elif tokens and WHOLE_BYTES.fullmatch(tokens[-1]) is None:  # only a text's last token can be an error
        wrong = tokens.pop()
    p.tail = held
    for literal in tokens:
        kind = KINDS[_FIRST[literal[0]]]
        error = p.accept(kind, many, max_level)
        text = put(kind, literal, error)
        if error:
            return out
        p.move(kind, literal, text)
        if kind != "White" and p.expect == "Eof":
            p.text_no += 1
    if wrong is not None:
        found = diagnose(wrong)
        put("Err", wrong[: found["at"]], {"class": "lexical"} | found)  # how much comes behind depends on the chunks
        return out
    if p.ended and not p.failed:
        put("Eof", b"", p.accept("Eof", many, max_level))
    return out


def _taken(p: Progress, many: bool, max_level: int) -> list[tuple]:
    """The tokens that the chunks which came make whole."""
    came = []
    while p.next in p.early and not p.ended:
        chunk, p.ended = p.early.pop(p.next)
        came.append(chunk)
        p.next += 1
    if not came:
        return []
    fresh = b"".join(came)
    p.tail += fresh
    # nothing that could end or break an open string has come: no need to lex it from its start again
    waits = not p.ended and p.tail[:1] == b'"' and len(fresh) < len(p.tail) and not _STOPS.search(fresh)
    return [] if waits else _advance(p, many, max_level)


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, many: bool, max_level: int, columns: list[str]) -> Iterator[pd.DataFrame]:
    """The tokens of a group of streams; its state maps an id to its Progress, or to None once nothing more can come."""
    streams: dict[str | None, Progress | None] = pickle.loads(state.get[0]) if state.exists else {}
    for frame in frames:
        touched = {}
        for stream, seq, chunk, eof in zip(frame["stream_id"], frame["seq"].tolist(), frame["chunk"], frame["eof"].tolist(), strict=True):
            if stream not in streams:
                streams[stream] = Progress()
            p = streams[stream]
            if p is not None and seq >= p.next:
                p.early[seq] = (bytes(chunk) if chunk is not None else b"", bool(eof))
                touched[stream] = p
        ids, rows = [], []
        for stream, p in touched.items():
            found = _taken(p, many, max_level)
            ids += [stream] * len(found)
            rows += found
            if p.ended or p.failed:
                streams[stream] = None
        made = dict(zip(TOKEN_COLUMNS, zip(*rows, strict=True), strict=True)) if rows else dict.fromkeys(TOKEN_COLUMNS, ())
        yield pd.DataFrame({"stream_id": ids} | {c: made[c] for c in columns})
    state.update((pickle.dumps(streams, pickle.HIGHEST_PROTOCOL),))


def parse_chunks(chunks: DataFrame, many: bool = True, max_level: int = 128, columns: list[str] | None = None, groups: int = 1024) -> DataFrame:
    """A stream of (stream_id string, seq long, chunk binary, eof boolean) to tokens, each as soon as it is whole.

    seq counts a stream's chunks from 0; chunks may come in any order and are taken in that of seq, repeated
    ones once.  eof marks the last; what is numbered behind it is no part of the stream.  many: a stream holds
    any number of texts, numbered by text_no.  The first error is a stream's last token; its message says what
    and where.  Columns are stream_id and those of TOKEN_COLUMNS asked for (all by default).

    groups: into so many groups streams are dealt, each one key of the state.  A micro-batch reads and writes the
    state of groups that it has chunks for, so a group should hold hundreds or thousands of small streams and
    few large ones.  A checkpoint holds for one number of groups.
    """
    names = columns or list(TOKEN_COLUMNS)
    step = partial(_step, many=many, max_level=max_level, columns=names)
    dealt = chunks.select(F.pmod(F.xxhash64("stream_id"), F.lit(groups)).alias("group"), "stream_id", "seq", "chunk", "eof")
    schema = ", ".join(["stream_id string", *(f"{n} {TOKEN_COLUMNS[n]}" for n in names)])
    return dealt.groupBy("group").applyInPandasWithState(step, schema, "progress binary", "append", GroupStateTimeout.NoTimeout)
