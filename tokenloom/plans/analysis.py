"""Columns of a batch of texts' tokens, derived for all tokens of the batch at once.

The input is what a text's tokens are: their literals in order, all texts of an Arrow batch one behind the
other.  Offsets, lines, levels, enclosing structures, expectations and the first error come from running
sums and searches in sorted arrays, not from a loop over tokens.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

import numpy as np
import pyarrow as pa

from tokenloom.plans.diagnosis import diagnose, message
from tokenloom.plans.grammar import ALLOWED, CODE, EXPECTATIONS, KINDS

ERR, EOF, WHITE, STR = CODE["Err"], CODE["Eof"], CODE["White"], CODE["Str"]
ARR, OBJ, ARR_END, OBJ_END = CODE["ArrBegin"], CODE["ObjBegin"], CODE["ArrEnd"], CODE["ObjEnd"]
NAME_SEP, VALUE_SEP = CODE["NameSep"], CODE["ValueSep"]
_FIRST = np.full(256, ERR, np.int8)
for _chars, _kind in (("[", "ArrBegin"), ("]", "ArrEnd"), ("{", "ObjBegin"), ("}", "ObjEnd"), (":", "NameSep"), (",", "ValueSep"), ('"', "Str"), ("-0123456789", "Num"), ("f", "LitFalse"), ("n", "LitNull"), ("t", "LitTrue"), (" \t\n\r", "White")):
    _FIRST[list(_chars.encode())] = CODE[_kind]
_EXPECT = {e: i for i, e in enumerate(EXPECTATIONS)}
_MAY = np.zeros((len(EXPECTATIONS), len(KINDS)), bool)
for _e, _kinds in ALLOWED.items():
    _MAY[_EXPECT[_e], [CODE[k] for k in _kinds]] = True
_PRIMITIVE = np.isin(np.arange(len(KINDS)), [CODE[k] for k in ("LitFalse", "LitNull", "LitTrue", "Num", "Str")])


def _looked_up(nodes: np.ndarray, keys: np.ndarray, find: Callable[[int, int], int]) -> np.ndarray:
    """find(node, key) for each pair, called once for each that differs."""
    if not len(nodes):
        return nodes
    span = int(keys.max()) + 1
    pairs, back = np.unique(nodes * span + keys, return_inverse=True)
    return np.array([find(*divmod(p, span)) for p in pairs.tolist()], np.int64)[back]


class Tokens:
    """literals: all tokens of the batch; counts: tokens per text; bad: texts whose last token is an error.

    level: an opening bracket that leads deeper is an error.  many: after a text's value another may follow.
    """

    def __init__(self, literals: pa.BinaryArray, counts: np.ndarray, bad: np.ndarray, level: int = 128, many: bool = False):
        self.counts, self.bad, self.max_level, self.many = counts, bad, level, many
        n = len(literals)
        self.n = n
        self.edge = np.frombuffer(literals.buffers()[1], np.int32, n + 1, literals.offset * 4).astype(np.int64)
        self.data = np.frombuffer(literals.buffers()[2] or b"", np.uint8)
        self.literals = literals
        self.first = np.cumsum(counts) - counts
        self.doc = np.repeat(np.arange(len(counts)), counts)
        self.index = np.arange(n)
        kind = _FIRST[self.data[self.edge[:-1]]] if n else np.zeros(0, np.int8)
        ends = self.first + counts - 1
        kind[ends[bad & (counts > 0)]] = ERR
        self.kind = kind

    @cached_property
    def level(self) -> np.ndarray:
        """Nesting after each token."""
        step = np.isin(self.kind, (ARR, OBJ)).astype(np.int64) - np.isin(self.kind, (ARR_END, OBJ_END))
        total = np.concatenate(([0], np.cumsum(step)))
        self.before = total[:-1] - total[self.first[self.doc]]
        return self.before + step

    def _opener(self, level: np.ndarray, index: np.ndarray) -> np.ndarray:
        """For each place the last bracket before index that leads to level in its text, or -1."""
        after = self.level
        openers = np.flatnonzero(np.isin(self.kind, (ARR, OBJ)))
        span = int(after.max(initial=0)) + 2
        keys = self.doc[openers] * span + after[openers]
        order = np.argsort(keys, kind="stable")
        openers, keys = openers[order], keys[order] * (self.n + 1) + openers[order]
        wanted = self.doc * span + np.clip(level, 0, span - 1)
        at = np.searchsorted(keys, wanted * (self.n + 1) + index) - 1
        found = openers[np.maximum(at, 0)] if len(openers) else np.zeros(self.n, np.int64)
        hit = (at >= 0) & (level > 0)
        if len(openers):
            hit &= keys[np.maximum(at, 0)] // (self.n + 1) == wanted
        return np.where(hit, found, -1)

    @cached_property
    def inside(self) -> np.ndarray:
        """The bracket that a token stands in (a closing one: its own opener), or -1."""
        level = self.level
        return self._opener(self.before if len(level) else level, self.index)

    @cached_property
    def leaves(self) -> np.ndarray:
        """The bracket that is open behind a token, or -1."""
        return self._opener(self.level, self.index + 1)

    @cached_property
    def last(self) -> np.ndarray:
        """The token before each that isn't white space, or -1."""
        seen = np.maximum.accumulate(np.where(self.kind != WHITE, self.index, -1)) if self.n else self.index
        seen = np.concatenate(([-1], seen[:-1])) if self.n else seen
        return np.where(seen >= self.first[self.doc], seen, -1)

    @cached_property
    def is_name(self) -> np.ndarray:
        """Strings that name a member."""
        inside, last = self.inside, self.last
        opens = np.isin(self.kind[last], (OBJ, VALUE_SEP)) & (last >= 0)
        return (self.kind == STR) & (inside >= 0) & (self.kind[inside] == OBJ) & opens

    @cached_property
    def value_ends(self) -> np.ndarray:
        return _PRIMITIVE[self.kind] & ~self.is_name | np.isin(self.kind, (ARR_END, OBJ_END))

    def _expected(self, last: np.ndarray) -> np.ndarray:
        """What may follow each of `last` (-1: a text's start)."""
        kind, leaves = self.kind[last], self.leaves[last]
        in_obj = (leaves >= 0) & (self.kind[leaves] == OBJ)
        out = np.full(len(last), _EXPECT["Value"])
        done = self.value_ends[last]
        for where, what in (
            (kind == ARR, "ArrElementOrEnd"),
            (kind == OBJ, "ObjNameOrEnd"),
            ((kind == VALUE_SEP) & in_obj, "ObjName"),
            (self.is_name[last], "ObjNameSep"),
            (done & (leaves < 0), "Value" if self.many else "Eof"),
            (done & (leaves >= 0) & in_obj, "ObjValueSepOrEnd"),
            (done & (leaves >= 0) & ~in_obj, "ArrElementSepOrEnd"),
        ):
            out[where & (last >= 0)] = _EXPECT[what]
        return out

    @cached_property
    def expect(self) -> np.ndarray:
        """What was expected at each token, as a number in EXPECTATIONS."""
        return self._expected(self.last) if self.n else np.zeros(0, np.int64)

    @cached_property
    def text_no(self) -> np.ndarray:
        """How many values of the text's top level ended before each token."""
        done = np.concatenate(([0], np.cumsum(self.value_ends & (self.leaves < 0)))) if self.n else np.zeros(1, np.int64)
        return done[:-1] - done[self.first[self.doc]]

    @cached_property
    def end_expect(self) -> np.ndarray:
        """What each text expected at its end."""
        if not self.n:
            return np.full(len(self.counts), _EXPECT["Value"])
        seen = np.maximum.accumulate(np.where(self.kind != WHITE, self.index, -1))
        last = np.where(self.counts > 0, seen[np.maximum(self.first + self.counts - 1, 0)], -1)
        return self._expected(np.where(last >= self.first, last, -1))

    def stops(self, syntax: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Per text the index of the first token that is an error (its count, if none is or it ended early), and whether it fails."""
        wrong = self.kind == ERR
        if syntax and self.n:
            wrong |= (self.kind != WHITE) & ~_MAY[self.expect, self.kind]
            wrong |= np.isin(self.kind, (ARR, OBJ)) & (self.level > self.max_level)
        at = np.flatnonzero(wrong)
        docs, one = np.unique(self.doc[at], return_index=True)
        stop, failed = self.counts.copy(), np.zeros(len(self.counts), bool)
        stop[docs], failed[docs] = at[one] - self.first[docs], True
        if syntax:
            fine = self.end_expect == _EXPECT["Eof"]
            if self.many:
                fine |= (self.end_expect == _EXPECT["Value"]) & ~np.isin(self._trailing(), (NAME_SEP, VALUE_SEP))
            failed |= ~fine & (stop == self.counts)
        return stop, failed

    def _trailing(self) -> np.ndarray:
        """The kind of each text's last token that isn't white space (White if none)."""
        out = np.full(len(self.counts), WHITE)
        solid = np.flatnonzero(self.kind != WHITE)
        out[self.doc[solid]] = self.kind[solid]
        return out

    def stacks(self, boxes: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
        """How many structures are open in each of boxes (brackets, -1: none), and their kinds, outermost first."""
        rows, places, open_ = [], [], np.arange(len(boxes))
        level = np.zeros(len(boxes), np.int64)
        while len(open_ := open_[boxes[open_] >= 0]):
            rows.append(open_)
            places.append(boxes[open_])
            level[open_] += 1
            boxes = boxes.copy()
            boxes[open_] = self.inside[boxes[open_]]
        if not rows:
            return level, pa.array([[]] * len(level), pa.list_(pa.string()))
        place = np.concatenate(places)
        depth = np.concatenate([level[r] - 1 - i for i, r in enumerate(rows)])
        order = np.lexsort((depth, np.concatenate(rows)))
        kinds = pa.array(["Arr", "Obj"]).take(pa.array((self.kind[place[order]] == OBJ).astype(np.int8)))
        return level, pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(level))).astype(np.int32)), kinds)

    def errors(self, docs: np.ndarray, stop: np.ndarray) -> list[dict]:
        """The errors of texts docs, each at its token stop; positions and stacks are found for all at once."""
        if not len(docs):
            return []
        at = self.first[docs] + stop[docs]
        over = stop[docs] == self.counts[docs]
        begin, base = self.edge[at], self.edge[self.first[docs]]
        behind = stop[docs] > 0
        level, stacks = self.stacks(np.where(behind, self.leaves[at - 1], -1) if self.n else np.full(len(docs), -1))
        token = np.where(over, EOF, self.kind[np.minimum(at, self.n - 1)] if self.n else EOF)
        expect = np.where(over, self.end_expect[docs], self.expect[np.minimum(at, self.n - 1)] if self.n else 0)
        out, fine, known = [], begin.copy(), {}
        for i, (k, d, n, stack) in enumerate(zip(token.tolist(), expect.tolist(), level.tolist(), stacks.to_pylist(), strict=True)):
            e = {"level": n, "stack": stack}
            if k == ERR:
                data = self.literal(int(at[i]))
                found = known.get(data)
                if found is None:
                    found = known[data] = diagnose(data)
                e |= {"class": "lexical"} | found
                fine[i] += e.pop("at")
            elif not _MAY[d, k]:
                e |= {"class": "syntax", "variant": "Syntax", "expect": EXPECTATIONS[d], "token": KINDS[k]}
            else:
                e |= {"class": "level", "variant": "Level", "token": KINDS[k], "level": self.max_level + 1}
            out.append(e)
        for name, where in (("token_pos", begin), ("err_pos", fine)):
            line, col = self._lines(base, where)
            for e, o, a, b in zip(out, (where - base).tolist(), line.tolist(), col.tolist(), strict=True):
                e[name] = {"offset": o, "line": a, "col": b}
        for e in out:
            e["message"] = message(e)
        return out

    @cached_property
    def _continuation(self) -> np.ndarray:
        return np.flatnonzero((self.data & 0xC0) == 0x80)

    @cached_property
    def _breaks(self) -> np.ndarray:
        """Bytes behind which a line starts: LF, and CR without LF in its text."""
        d = self.data
        follows = np.concatenate((d[1:] == 10, [False])) if len(d) else np.zeros(0, bool)
        ends = self.edge[self.first + self.counts][self.counts > 0] - 1
        follows[ends] = False
        return np.flatnonzero((d == 10) | (d == 13) & ~follows)

    def _lines(self, start: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Line and column of bytes `at` of texts that begin at `start`."""
        breaks, cont = self._breaks, self._continuation
        k, k0 = np.searchsorted(breaks, at), np.searchsorted(breaks, start)
        line_start = np.where(k > k0, breaks[np.maximum(k - 1, 0)] + 1 if len(breaks) else start, start)
        chars = at - line_start - (np.searchsorted(cont, at) - np.searchsorted(cont, line_start))
        return 1 + k - k0, 1 + chars

    @cached_property
    def offset(self) -> np.ndarray:
        return self.edge[:-1] - self.edge[self.first[self.doc]]

    @cached_property
    def position(self) -> tuple[np.ndarray, np.ndarray]:
        return self._lines(self.edge[self.first[self.doc]], self.edge[:-1])

    @cached_property
    def is_value(self) -> np.ndarray:
        """Tokens at which a value begins."""
        return _PRIMITIVE[self.kind] & ~self.is_name | np.isin(self.kind, (ARR, OBJ))

    @cached_property
    def closer(self) -> np.ndarray:
        """For an opening bracket the one that closes it, for others themselves; -1 if it stays open."""
        out = np.where(np.isin(self.kind, (ARR, OBJ)), -1, self.index)
        closing = np.flatnonzero(np.isin(self.kind, (ARR_END, OBJ_END)))
        own = self.inside[closing]
        out[own[own >= 0]] = closing[own >= 0]
        return out

    def names_of(self, values: np.ndarray) -> np.ndarray:
        """The name tokens of values that are members."""
        return self.last[self.last[values]]

    def places_of(self, values: np.ndarray) -> np.ndarray:
        """The array indexes of values that are elements."""
        commas = np.flatnonzero(self.kind == VALUE_SEP)
        keys = np.sort(self.inside[commas] * (self.n + 1) + commas)
        box = self.inside[values] * (self.n + 1)
        return np.searchsorted(keys, box + values) - np.searchsorted(keys, box)

    def literal(self, i: int) -> bytes:
        return self.data[self.edge[i] : self.edge[i + 1]].tobytes()

    def states(self, group, upto: np.ndarray) -> np.ndarray:
        """Per token the node of the group's tree that its value (for a closing bracket: its opener's) has reached, or -1.

        One round a level of the pointers; only members and elements of values that a longer pointer leads
        through are looked at.
        """
        state = np.full(self.n, -1, np.int64)
        if not self.n:
            return state
        good = self.is_value & (self.index - self.first[self.doc] < upto[self.doc])
        self.level  # noqa: B018  sets before
        state[good & (self.before == 0)] = 0
        inner = np.array([bool(x) for x in group.children])
        for depth in range(1, group.depth + 1):
            mine = np.flatnonzero(good & (self.before == depth) & (self.inside >= 0))
            reached = state[self.inside[mine]]
            mine = mine[(reached >= 0) & inner[np.maximum(reached, 0)]]
            if not len(mine):
                break
            member = self.kind[self.inside[mine]] == OBJ
            values = mine[member]
            names = self.literals.take(pa.array(self.names_of(values))).dictionary_encode()
            texts = names.dictionary.to_pylist()
            state[values] = _looked_up(state[self.inside[values]], names.indices.to_numpy(), lambda node, name: group.member(node, texts[name]))
            values = mine[~member]
            state[values] = _looked_up(state[self.inside[values]], self.places_of(values), group.element)
        closing = np.flatnonzero(np.isin(self.kind, (ARR_END, OBJ_END)) & (self.inside >= 0) & (self.index - self.first[self.doc] < upto[self.doc]))
        state[closing] = state[self.inside[closing]]
        return state
