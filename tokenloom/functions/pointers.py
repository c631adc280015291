"""RFC 6901 JSON Pointers: single ones as columns, and groups of them as a tree to walk texts with."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

VALID = r"^(/([^~]|~[01])*)?\z"
_INDEX = re.compile(r"0|[1-9][0-9]*")
MAX_INDEX = (1 << 64) - 1


class PointerError(ValueError):
    """kind is no_slash or naked_tilde; index is the byte of a `~` that 0 or 1 doesn't follow."""

    def __init__(self, pointer: str, kind: str, index: int | None = None):
        super().__init__(f"{pointer!r}: " + ("a pointer that isn't empty starts with '/'" if kind == "no_slash" else f"'~' without 0 or 1 behind it (byte {index})"))
        self.kind, self.index = kind, index


def check_pointer(pointer: str) -> str:
    """The pointer itself, or PointerError."""
    if pointer and pointer[0] != "/":
        raise PointerError(pointer, "no_slash")
    if bad := re.search("~(?![01])", pointer):
        raise PointerError(pointer, "naked_tilde", len(pointer[: bad.start()].encode()))
    return pointer


def steps(pointer: str) -> list[str]:
    """The reference tokens of a pointer, unescaped; none for the empty pointer."""
    return [s.replace("~1", "/").replace("~0", "~") for s in check_pointer(pointer).split("/")[1:]]


def pointer_status(pointer: Column) -> Column:
    """ok, no_slash or naked_tilde; null for null."""
    return F.when(pointer.rlike(VALID), "ok").when((pointer != "") & ~pointer.startswith("/"), "no_slash").otherwise(F.when(pointer.isNotNull(), "naked_tilde"))


def pointer_tilde(pointer: Column) -> Column:
    """The byte index of the first naked tilde of a pointer that starts well, else null."""
    at = F.octet_length(F.regexp_extract(pointer, r"^((?:[^~]|~[01])*+)", 1))
    return F.when(pointer_status(pointer) == "naked_tilde", at)


def pointer_steps(pointer: Column) -> Column:
    """The reference tokens of a valid pointer as an array; null for an invalid one."""
    parts = F.transform(F.slice(F.split(pointer, "/", -1), 2, F.octet_length(pointer) + 1), lambda s: F.replace(F.replace(s, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")))
    return F.when(pointer.rlike(VALID), F.when(pointer == "", F.array().cast("array<string>")).otherwise(parts))


class Group:
    """A set of pointers, compiled to a tree of steps.  Small, and sent with the tasks that use it.

    ignore_case: pointers and names are compared after Unicode case folding; of pointers that fold alike
    the lexicographically first stays.  unescape: names' escapes are expanded before they are compared.
    """

    def __init__(self, pointers: list[str], ignore_case: bool = False, unescape: bool = True):
        self.ignore_case, self.unescape = ignore_case, unescape
        self.children: list[dict[str, int]] = [{}]
        self.elements: list[dict[int, int]] = [{}]
        self.pointer_at: list[str | None] = [None]
        self.depth = 0
        for pointer in sorted(set(map(check_pointer, pointers))):
            node, own = 0, steps(pointer)
            for step in own:
                step = step.casefold() if ignore_case else step
                if step not in self.children[node]:
                    self.children[node][step] = len(self.children)
                    if _INDEX.fullmatch(step) and int(step) <= MAX_INDEX:
                        self.elements[node][int(step)] = len(self.children)
                    self.children.append({})
                    self.elements.append({})
                    self.pointer_at.append(None)
                node = self.children[node][step]
            if self.pointer_at[node] is None:
                self.pointer_at[node] = pointer
            self.depth = max(self.depth, len(own))

    @property
    def pointers(self) -> list[str]:
        return [p for p in self.pointer_at if p is not None]

    def member(self, node: int, literal: bytes) -> int:
        """The node below `node` of the member that a name token names, or -1."""
        if self.unescape and b"\\" in literal:
            name = json.loads(literal)
        else:
            name = literal[1:-1].decode()
        return self.children[node].get(name.casefold() if self.ignore_case else name, -1)

    def element(self, node: int, place: int) -> int:
        return self.elements[node].get(place, -1)
