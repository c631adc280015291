"""What is wrong with the text of an error token: variant, fields and where, for the few rows that have one."""

from __future__ import annotations

import re

from tokenloom.plans.grammar import DISPLAY, EXPECT_TEXT, STRING_BODY

_WORDS = {0x66: ("LitFalse", b"false"), 0x6E: ("LitNull", b"null"), 0x74: ("LitTrue", b"true")}
#: What a lexer may expect, as messages put it.
LEXICAL_TEXT = {
    "Boundary": "boundary character or EOF",
    "Digit": "digit",
    "DigitDotExpOrBoundary": "digit, '.', exponent, boundary character or EOF",
    "DigitExpOrBoundary": "digit, exponent, boundary character or EOF",
    "DigitOrBoundary": "digit, boundary character or EOF",
    "DigitOrExpSign": "exponent sign or digit",
    "DotExpOrBoundary": "'.', exponent, boundary character or EOF",
    "EscChar": "escape character",
    "StrChar": "string character",
    "TokenStartChar": "token start character",
    "UnicodeEscHexDigit": "hexadecimal digit",
}


def _found(variant: str, at: int, **fields) -> dict:
    return {"variant": variant, "at": at} | fields


def _byte(data: bytes, at: int, token: str | None, expect: str) -> dict:
    if at == len(data):
        return _found("UnexpectedEof", at, token=token)
    return _found("UnexpectedByte", at, token=token, expect=expect, actual=data[at])


def _number(data: bytes) -> dict:
    digits = lambda i: re.compile(rb"[0-9]*+").match(data, i).end()
    at = int(data[:1] == b"-")
    if not data[at : at + 1].isdigit():
        return _byte(data, at, "Num", "Digit")
    zero = data[at : at + 1] == b"0"
    at = at + 1 if zero else digits(at)
    expect = "DotExpOrBoundary" if zero else "DigitDotExpOrBoundary"
    if data[at : at + 1] == b".":
        end = digits(at + 1)
        if end == at + 1:
            return _byte(data, end, "Num", "Digit")
        at, expect = end, "DigitExpOrBoundary"
    if data[at : at + 1] in (b"e", b"E"):
        at += 1
        signed = data[at : at + 1] in (b"+", b"-")
        end = digits(at + signed)
        if end == at + signed:
            return _byte(data, end, "Num", "Digit" if signed else "DigitOrExpSign")
        at, expect = end, "DigitOrBoundary"
    return _byte(data, at, "Num", expect)


def _hex(data: bytes, at: int) -> tuple[int | None, int]:
    """Four hexadecimal digits from at on: their value, or None and the first byte that is none."""
    for i in range(at, at + 4):
        if data[i : i + 1] not in (*(bytes([c]) for c in b"0123456789abcdefABCDEF"),):
            return None, i
    return int(data[at : at + 4], 16), at + 4


def _utf8(data: bytes, at: int) -> dict:
    lead = data[at]
    size = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0
    if not size:
        return _byte(data, at, "Str", "StrChar")
    low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(lead, (0x80, 0xBF))
    for i in range(1, size):
        if at + i == len(data):
            return _found("UnexpectedEof", at + i, token="Str")
        if not low <= data[at + i] <= high:
            return _found("BadUtf8ContByte", at, seq_len=size, byte_no=i, actual=data[at + i])
        low, high = 0x80, 0xBF
    raise AssertionError("a valid sequence")


def _string(data: bytes) -> dict:
    at = STRING_BODY.match(data, 1).end()
    if at == len(data) or data[at] < 0x20:
        return _byte(data, at, "Str", "StrChar")
    if data[at] >= 0x80:
        return _utf8(data, at)
    if data[at + 1 : at + 2] != b"u":
        return _byte(data, at + 1, "Str", "EscChar")
    first, end = _hex(data, at + 2)
    if first is None:
        return _byte(data, end, "Str", "UnicodeEscHexDigit")
    if 0xDC00 <= first <= 0xDFFF:
        return _found("BadSurrogate", at + 2, first=first)
    for i, c in ((end, b"\\"), (end + 1, b"u")):
        if i >= len(data):
            return _found("UnexpectedEof", i, token="Str")
        if data[i : i + 1] != c:
            return _found("BadSurrogate", at + 2, first=first)
    second, stop = _hex(data, end + 2)
    if second is None:
        return _byte(data, stop, "Str", "UnicodeEscHexDigit")
    return _found("BadSurrogate", end + 2, first=first, second=second)


def diagnose(data: bytes) -> dict:
    """The error at whose token `data` starts: variant, at (bytes from the token's start) and the variant's fields."""
    first = data[0]
    if first == 0x22:
        return _string(data)
    if first == 0x2D or 0x30 <= first <= 0x39:
        return _number(data)
    if first in _WORDS:
        token, word = _WORDS[first]
        same = next((i for i, c in enumerate(word) if data[i : i + 1] != bytes([c])), len(word))
        return _byte(data, same, token, f"Char({chr(word[same])})" if same < len(word) else "Boundary")
    return _byte(data, 0, None, "TokenStartChar")


def position_text(offset: int, line: int, col: int) -> str:
    return f"line {line}, column {col} (offset: {offset})"


def message(error: dict) -> str:
    """`<what> at line L, column C (offset: O)`, the position being the token's."""
    where = position_text(*error["token_pos"].values())
    if error["class"] == "syntax":
        return f"syntax error: {DISPLAY[error['token']]} where {EXPECT_TEXT[error['expect']]} belongs at {where}"
    if error["class"] == "level":
        return f"level error: level {error['level']} exceeds the greatest level allowed, on {DISPLAY[error['token']]} at {where}"
    kind, token = error["variant"], f" in {DISPLAY[error['token']]} token" if error.get("token") else ""
    if kind == "UnexpectedEof":
        what = f"the text ends{token}"
    elif kind == "UnexpectedByte":
        actual = error["actual"]
        seen = f"'{chr(actual)}' (0x{actual:02x})" if 0x20 <= actual <= 0x7E else f"byte 0x{actual:02x}"
        expect = error["expect"]
        what = f"{seen} where {LEXICAL_TEXT.get(expect) or repr(expect[5:-1])} belongs{token}"
    elif kind == "BadUtf8ContByte":
        what = f"byte {error['byte_no']} behind the first of a UTF-8 sequence of {error['seq_len']} bytes is 0x{error['actual']:02x}"
    elif error.get("second") is not None:
        what = f"bad surrogate pair: \\u{error['first']:04X} followed by \\u{error['second']:04X}"
    elif error["first"] >= 0xDC00:
        what = f"bad surrogate: low \\u{error['first']:04X} follows no high one"
    else:
        what = f"bad surrogate: high \\u{error['first']:04X} has no low one behind it"
    return f"lexical error: {what} at {where}"
