"""Functions of tokens and literals, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenloom.plans import grammar

I64 = (-(1 << 63), (1 << 63) - 1)
U64 = (0, (1 << 64) - 1)
I128 = (-(1 << 127), (1 << 127) - 1)


def _is(kind: Column, kinds: tuple[str, ...]) -> Column:
    return kind.isin(*kinds)


def is_eof(kind: Column) -> Column:
    return kind == "Eof"


def is_err(kind: Column) -> Column:
    return kind == "Err"


def is_literal(kind: Column) -> Column:
    """true, false or null."""
    return _is(kind, grammar.LITERALS)


def is_primitive(kind: Column) -> Column:
    """Literals, numbers and strings."""
    return _is(kind, grammar.PRIMITIVES)


def is_pseudo(kind: Column) -> Column:
    """End, error and white space."""
    return _is(kind, grammar.PSEUDO)


def is_punct(kind: Column) -> Column:
    """Separators, brackets not among them."""
    return _is(kind, grammar.PUNCTUATION)


def is_struct(kind: Column) -> Column:
    """The four brackets."""
    return _is(kind, grammar.STRUCTURAL)


def is_terminal(kind: Column) -> Column:
    return _is(kind, grammar.TERMINAL)


def _lookup(kind: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, text in table.items():
        out = F.when(kind == k, text).otherwise(out)
    return out


def static_content(kind: Column) -> Column:
    """The text of the nine kinds that have but one, else null."""
    return _lookup(kind, grammar.STATIC)


def display(kind: Column) -> Column:
    """How a kind reads in a message."""
    return _lookup(kind, grammar.DISPLAY)


def allowed_tokens(expect: Column) -> Column:
    """The kinds an expectation admits."""
    out = F.lit(None).cast("array<string>")
    for e, kinds in grammar.ALLOWED.items():
        own = F.array(*map(F.lit, kinds)) if e != "Eof" else F.array().cast("array<string>")
        out = F.when(expect == e, own).otherwise(out)
    return out


def literal_len(literal: Column) -> Column:
    """Bytes of a literal."""
    return F.octet_length(literal)


def is_escaped(kind: Column, literal: Column) -> Column:
    """A string that holds an escape."""
    return (kind == "Str") & F.contains(literal, F.lit("\\"))


def unescape(literal: Column) -> Column:
    """A string token's text, or a string without its quotes, with escapes expanded; quotes stay if there are any.

    Only texts with an escape are parsed.  What isn't a valid string gives null.
    """
    quoted = literal.rlike('^"(?s:.)*"$') & (F.length(literal) > 1)
    inner = F.when(quoted, literal).otherwise(F.concat(F.lit('"'), literal, F.lit('"')))
    parsed = F.from_json(F.concat(F.lit("["), F.when(inner.rlike(rf"^(?:{grammar.STRING})\z"), inner), F.lit("]")), "array<string>")[0]
    return F.when(~F.contains(literal, F.lit("\\")), literal).otherwise(F.when(quoted, F.concat(F.lit('"'), parsed, F.lit('"'))).otherwise(parsed))


def content_unescaped(kind: Column, literal: Column) -> Column:
    """A token's text, escapes of strings expanded and quotes kept."""
    return F.when(kind == "Str", unescape(literal)).otherwise(literal)


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by bytes; null beside null."""
    return F.when(a < b, -1).when(a == b, 0).when(a > b, 1)


def unescaped_compare(literal: Column, other: Column) -> Column:
    """A literal's expanded text against a plain one; quotes count on both sides."""
    return compare(unescape(literal), other)


def _whole(literal: Column, low: int, high: int, signed: bool) -> tuple[Column, Column]:
    """Status and canonical text of a whole number between low and high, at any length of digits."""
    form = literal.rlike(r"^-?[0-9]+\z" if signed else r"^[0-9]+\z") & literal.rlike(grammar.NUMBER)
    digits = F.ltrim(F.ltrim(literal, F.lit("-")), F.lit("0"))
    negative = literal.startswith("-") & (digits != "")
    plain = F.when(digits == "", "0").otherwise(F.concat(F.when(negative, "-").otherwise(""), digits))
    most = F.when(negative, str(-low)).otherwise(str(high))
    fits = (F.length(digits) < F.length(most)) | (F.length(digits) == F.length(most)) & (digits <= most)
    status = F.when(literal.isNull(), F.lit(None)).when(~form, "format").when(fits, "ok").otherwise("range")
    return status, F.when(status == "ok", plain)


def parse_i64(literal: Column) -> Column:
    """(status, value long): ok, format or range."""
    status, text = _whole(literal, *I64, True)
    return F.struct(status.alias("status"), text.cast("long").alias("value"))


def parse_u64(literal: Column) -> Column:
    """(status, value decimal(20,0)); any sign is a format error."""
    status, text = _whole(literal, *U64, False)
    return F.struct(status.alias("status"), text.cast("decimal(20,0)").alias("value"))


def parse_i128(literal: Column) -> Column:
    """(status, value string): the canonical text, as 39 digits exceed a decimal."""
    status, text = _whole(literal, *I128, True)
    return F.struct(status.alias("status"), text.alias("value"))


def parse_f64(literal: Column) -> Column:
    """(status, value double), to the nearest; what overflows is a range error, what underflows is not."""
    form = literal.rlike(grammar.NUMBER)
    value = F.when(form, literal.try_cast("double"))
    infinite = F.abs(value) == float("inf")
    status = F.when(literal.isNull(), F.lit(None)).when(~form, "format").when(infinite, "range").otherwise("ok")
    return F.struct(status.alias("status"), F.when(status == "ok", value).alias("value"))


def position_text(offset: Column, line: Column, col: Column) -> Column:
    return F.format_string("line %d, column %d (offset: %d)", line, col, offset)
