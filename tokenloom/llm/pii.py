"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their score.

Row-wise work in Arrow batches; nothing is shuffled.  Each pattern runs in time linear in the text: a run of
characters is never tried again from each of its places.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import whole_text

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){13,}")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
KINDS = ("email", "ip", "card", "phone", "iban")
#: Where a span starts from before its context: our own choice.
BASE_SCORES = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.5, "iban": 0.8}
#: Words that speak for a kind, and words that speak against any: our own choice.
CONTEXT = {
    "email": ("mail", "contact", "kontakt", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "karte", "tarjeta", "carte"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "teléfono", "téléphone", "whatsapp"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"),
}
AGAINST = ("example", "version", "isbn", "issn", "order", "serial", "sku", "doi")
REACH = 48
LIFT, DROP = 0.2, 0.3
_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    """The Luhn sum of a string of digits is a multiple of ten."""
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def mod97(iban: str) -> bool:
    """An IBAN without blanks, rearranged and read as a number, leaves 1 over 97."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Spans of `local@label(.label)+`, leftmost, each from the first local character behind the last span."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        start = at - (len(before) - len(before.rstrip(LOCAL)))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        free = at + 1
        if domain:
            out.append((start, domain.end()))
            free = domain.end()
        at = text.find("@", free)
    return out


def ibans(text: str) -> list[tuple[int, int]]:
    """Spans of IBANs, leftmost, the longest end at a border of groups that mod-97 confirms.

    A match may have run on into the next word or number, or begun before the IBAN: where no end is
    confirmed the search goes on behind the match's country and check digits, else behind the span.
    """
    out, m = [], _IBAN.search(text)
    while m:
        start, end = m.span()
        free = start + 4
        while end - start >= 12:
            if mod97(text[start:end].replace(" ", "")):
                out.append((start, end))
                free = end
                break
            end = text.rfind(" ", start, end)
        m = _IBAN.search(text, free)
    return out


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every confirmed span, by start, then kind as listed in KINDS."""
    found = [(a, b, 0) for a, b in emails(text)] if "@" in text else []
    found += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if all(map(_byte, m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if len(digits) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), 2))
    if "+" in text:
        found += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    found += [(a, b, 4) for a, b in ibans(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda x: (x[0], x[2], x[1]))]


def score(text: str, start: int, end: int, kind: str) -> float:
    """The kind's base score, more with a word of its context nearby, less with one against it; 0 to 1."""
    near = {w.lower() for w in _WORD.findall(text[max(0, start - REACH) : start] + " " + text[end : end + REACH // 2])}
    value = BASE_SCORES[kind] + LIFT * bool(near & set(CONTEXT[kind])) - DROP * bool(near & set(AGAINST))
    return round(min(1.0, max(0.0, value)), 2)


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("text", pa.string())])


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for value in batch.column(batch.schema.get_field_index("_text")):
            text = value.as_py()
            out.append([{"kind": k, "start": a, "end": b, "score": score(text, a, b, k), "text": text[a:b]} for a, b, k in find(text)])
        rest = batch.drop_columns(["_text"])
        yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(out, pa.list_(_SPAN))], [*rest.schema.names, "pii"])


def personal_data(docs: DataFrame) -> DataFrame:
    """docs with text -> its other columns and pii, an array of (kind, start, end, score, text).

    Offsets are code points, end exclusive.  Null text counts as empty and has no spans.  Repeated rows and null
    ids stay as they are, no rows give none, and another column named pii is an error.
    """
    if "pii" in (c.lower() for c in docs.columns):
        raise ValueError("a column is named pii: rename it first")
    rest = docs.drop("text").schema
    texts = docs.select(*(f"`{f.name}`" for f in rest), whole_text().alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "pii array<struct<kind:string,start:long,end:long,score:double,text:string>>"])
    return texts.mapInArrow(_rows, schema)
