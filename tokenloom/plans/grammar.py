"""Token kinds, expectations and the patterns of RFC 8259, for the JVM's and for Python's regular expressions."""

from __future__ import annotations

import re

#: The token kinds, fixed values.
KINDS = ("ArrBegin", "ArrEnd", "Eof", "Err", "LitFalse", "LitNull", "LitTrue", "NameSep", "Num", "ObjBegin", "ObjEnd", "Str", "ValueSep", "White")
CODE = {k: i for i, k in enumerate(KINDS)}
LITERALS = ("LitFalse", "LitNull", "LitTrue")
PRIMITIVES = (*LITERALS, "Num", "Str")
PSEUDO = ("Eof", "Err", "White")
PUNCTUATION = ("NameSep", "ValueSep")
STRUCTURAL = ("ArrBegin", "ArrEnd", "ObjBegin", "ObjEnd")
TERMINAL = ("Eof", "Err")
#: Kinds whose text never varies, fixed values.
STATIC = {"ArrBegin": "[", "ArrEnd": "]", "LitFalse": "false", "LitNull": "null", "LitTrue": "true", "NameSep": ":", "ObjBegin": "{", "ObjEnd": "}", "ValueSep": ","}
#: How a kind is named in a message, fixed values.
DISPLAY = STATIC | {"Eof": "EOF", "Err": "error", "Num": "number", "Str": "string", "White": "whitespace"}

_VALUES = ("ArrBegin", "LitFalse", "LitNull", "LitTrue", "Num", "ObjBegin", "Str")
#: What may come next, by expectation; white space always may.
ALLOWED = {
    "Value": _VALUES,
    "ObjName": ("Str",),
    "ObjNameOrEnd": ("Str", "ObjEnd"),
    "ObjNameSep": ("NameSep",),
    "ObjValueSepOrEnd": ("ObjEnd", "ValueSep"),
    "ArrElementOrEnd": (*_VALUES, "ArrEnd"),
    "ArrElementSepOrEnd": ("ArrEnd", "ValueSep"),
    "Eof": ("Eof",),
}
EXPECTATIONS = tuple(ALLOWED)
#: What a parser may expect, as messages put it.
EXPECT_TEXT = {
    "Value": "a value",
    "ObjName": "a member's name",
    "ObjNameOrEnd": "a member's name or }",
    "ObjNameSep": "a colon",
    "ObjValueSepOrEnd": "a comma or }",
    "ArrElementOrEnd": "a value or ]",
    "ArrElementSepOrEnd": "a comma or ]",
    "Eof": "nothing more",
}

_HEX = "[0-9A-Fa-f]"
ESCAPE = rf'\\(?:["\\/bfnrt]|u(?:[0-9A-Ca-cEeFf]{_HEX}{{3}}|[Dd][0-7]{_HEX}{{2}}|[Dd][89ABab]{_HEX}{{2}}\\u[Dd][C-Fc-f]{_HEX}{{2}}))'
_NUMBER = r"-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?"
_BOUNDARY = r'(?=[{}\[\]:,"\x20\t\n\r]|\z)'
_PLAIN = r'[^"\\\x00-\x1f]*+'
STRING = rf'"{_PLAIN}(?:{ESCAPE}{_PLAIN})*+"'
_WHITE = r"[\x20\t\n\r]++"
_VALID = rf"{STRING}|(?:{_NUMBER}|true|false|null){_BOUNDARY}|[{{}}\[\]:,]|{_WHITE}"
#: One token a match; what starts no token, and all behind it, is one last match.
TOKEN = rf"(?:{_VALID}|(?s:.++))"
#: A whole valid token.
WHOLE = rf"^(?:{STRING}|{_NUMBER}|true|false|null|[{{}}\[\]:,]|{_WHITE})\z"
NUMBER = rf"^{_NUMBER}\z"

#: The same over UTF-8 bytes, for texts that aren't UTF-8 throughout and for chunks of a stream.
_CHAR = rb"[\x20-\x21\x23-\x5b\x5d-\x7f]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}"
_E = ESCAPE.encode()
STRING_BODY = re.compile(rb"(?:[\x20-\x21\x23-\x5b\x5d-\x7f]++|" + _CHAR + rb"|" + _E + rb")*+")
TOKEN_BYTES = re.compile(rb'(?s)"' + STRING_BODY.pattern + rb'"|(?:' + _NUMBER.encode() + rb'|true|false|null)(?=[{}\[\]:,"\x20\t\n\r]|\Z)|[{}\[\]:,]|[\x20\t\n\r]++|(?:.++)')
WHOLE_BYTES = re.compile(rb'"' + STRING_BODY.pattern + rb'"|' + _NUMBER.encode() + rb"|true|false|null|[{}\[\]:,]|[\x20\t\n\r]++")
