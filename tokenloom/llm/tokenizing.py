"""Token ids of whole texts with the `tokenizers` library, at the speed of a dictionary.

The two vocabularies in use cut a text into pieces before any merge.  Some places are between two pieces
whatever stands around them: before a blank behind another character, and between ASCII letters (or Latin-1
ones), digits and marks.  A batch of texts is cut there into units, all at once over its bytes; distinct units
are looked up in what the Python worker remembers (two generations of bounded size), and only new ones go to
the library, a unit of letters alone straight to its merges.  Ids of all units are then put in their places.

Texts for which a place could differ are one unit each, and the library sees them whole: those with an added
token's opening "<|", with white space that isn't ASCII, or, for the vocabulary that normalises, with anything
beyond U+017F (there, within U+017F, NFC changes nothing and lower-casing is per character; U+0130 is excepted).
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import cache
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Units in a generation of a worker's memory, at some 200 bytes each.
GENERATION = 500_000
#: Bytes of the longest unit that is remembered.
REMEMBERED = 64
SLICE_BYTES = 8 << 20
_ODD_SPACE = r"\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
_KEEPS_SPACE = rf"[{_ODD_SPACE}]|<\|"
_DROPS_SPACE = rf"[{_ODD_SPACE}\x{{130}}\x{{180}}-\x{{10ffff}}]|<\|"
#: Byte-level vocabularies spell bytes as characters: visible ones of Latin-1 as they are, others from U+0100 on.
_SEEN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SPELLING = {b: chr(b) for b in _SEEN} | {b: chr(0x100 + i) for i, b in enumerate(b for b in range(0x100) if b not in _SEEN)}
#: Bytes of letters from A to U+017F in UTF-8, and of a few other characters.
_LATIN = bytes([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5])
_ID = attrgetter("id")

_OTHER, _LETTER, _DIGIT, _MARK, _QUOTE, _SPACE = range(6)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[0x21:0x7F] = _MARK
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x27] = _QUOTE
_CLASS[[0x20, *range(0x09, 0x0E)]] = _SPACE
#: By class of a byte and of the next (8 * first + second): whether two pieces always meet between them.
_MEET = np.zeros(64, bool)
for _a in range(_SPACE):
    _MEET[8 * _a + _SPACE] = True
for _a, _b in ((_LETTER, _DIGIT), (_LETTER, _MARK), (_LETTER, _QUOTE), (_DIGIT, _LETTER), (_DIGIT, _MARK), (_DIGIT, _QUOTE), (_MARK, _LETTER), (_MARK, _DIGIT)):
    _MEET[8 * _a + _b] = True


def _joints(data: np.ndarray) -> np.ndarray:
    """For each byte of some texts, one behind the other, whether a unit may start there."""
    kind = _CLASS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[~np.isin(data[lead + 1], (0x97, 0xB7))]  # U+00C0 to U+00FF are letters but for two
    kind[lead] = kind[lead + 1] = _LETTER
    out = np.ones(len(data), bool)
    out[1:] = _MEET[kind[:-1] << 3 | kind[1:]]
    if len(data) > 2:  # one line break between other characters is a piece of its own before a letter
        out[2:] |= (data[1:-1] == 0x0A) & (kind[2:] == _LETTER) & (kind[:-2] != _SPACE)
    return out


def _bytes_of(values: pa.LargeBinaryArray) -> list[bytes]:
    edge = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1, 8 * values.offset).tolist()
    return list(map(values.buffers()[2].to_pybytes().__getitem__, map(slice, edge[:-1], edge[1:])))


class Encoder:
    """An array of texts -> token ids, without special tokens.

    path: a tokenizers JSON file of a byte-level BPE.  Every worker reads it once.
    """

    def __init__(self, path: str, generation: int = GENERATION):
        self.library = Tokenizer.from_file(path)
        self.merge = self.library.model.tokenize
        self.drops_space = self.library.normalizer is not None
        self.whole = _DROPS_SPACE if self.drops_space else _KEEPS_SPACE
        self.generation = generation
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = self.kind.char
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        got = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [array(self.code, e.ids).tobytes() for e in got]

    def _piece(self, unit: bytes) -> bytes | None:
        """The ids of a unit of letters alone, with or without a blank before them: one piece.  None for any other."""
        stem = unit[1:] if unit[:1] == b" " else unit
        if stem.isalpha():  # of ASCII alone
            text = (stem.lower() if self.drops_space else stem).decode()
        elif stem.translate(None, _LATIN) or not stem.decode().isalpha() or b"\xc4\xb0" in stem:
            return None
        else:
            text = "".join(map(_SPELLING.__getitem__, stem.decode().lower().encode() if self.drops_space else stem))
        if stem is not unit and not self.drops_space:
            text = _SPELLING[0x20] + text
        return array(self.code, map(_ID, self.merge(text))).tobytes()

    def _ids(self, units: list[bytes]) -> list[bytes]:
        """The ids of distinct units."""
        if len(self.new) > self.generation:
            self.old, self.new = self.new, {}
        new, known, piece = self.new, self.old.get, self._piece
        found, others = list(map(new.get, units)), []
        for i, ids in enumerate(found):
            if ids is None:
                unit = units[i]
                ids = known(unit) or piece(unit)
                if ids is None:
                    others.append(i)
                    continue
                found[i] = ids
                if len(unit) <= REMEMBERED:
                    new[unit] = ids
        for i, ids in zip(others, self._library([units[i].decode() for i in others]), strict=True):
            found[i] = ids
            if len(units[i]) <= REMEMBERED:
                new[units[i]] = ids
        return found

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (strings, none null) one behind the other, and how many each has."""
        texts = texts.cast(pa.large_string())
        edge = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edge[0] : edge[-1]]
        edge = edge - edge[0]
        if not len(data):
            return np.zeros(0, self.kind), np.zeros(len(texts), np.int64)
        starts = _joints(data)
        for i in np.flatnonzero(pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False)).tolist():
            starts[edge[i] : edge[i + 1]] = False
        starts[edge[:-1][edge[:-1] < len(data)]] = True
        starts = np.flatnonzero(starts)
        ends = np.append(starts, len(data))
        units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])
        coded = units.dictionary_encode()
        known = self._ids(_bytes_of(coded.dictionary))
        upto = np.concatenate(([0], np.cumsum(np.fromiter(map(len, known), np.int64, len(known)))))
        pool = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(known), [None, pa.py_buffer(upto), pa.py_buffer(b"".join(known))])
        placed = pool.take(coded.indices)
        upto = np.frombuffer(placed.buffers()[1], np.int64, len(starts) + 1) // self.kind.itemsize
        ids = np.frombuffer(placed.buffers()[2], self.kind, int(upto[-1]))
        return ids, np.diff(upto[np.searchsorted(starts, edge)])

    def slices(self, texts: pa.Array, end_id: int, size: int = SLICE_BYTES) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Slices of about size bytes with their ids, end_id behind each text, and how many each text has.

        What is held at once doesn't grow with the batch.
        """
        upto = np.concatenate(([0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))))
        begun = 0
        while begun < len(texts):
            behind = max(begun + 1, int(np.searchsorted(upto, upto[begun] + size, "right")) - 1)
            ids, counts = self(texts.slice(begun, behind - begun))
            ids = np.insert(ids.astype("<u4") if end_id >= 1 << 8 * self.kind.itemsize else ids, np.cumsum(counts), end_id)
            yield slice(begun, behind), ids, counts + 1
            begun = behind


@cache
def encoder(path: str) -> Encoder:
    """This worker's encoder of the vocabulary in path."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks share the cores already
    return Encoder(path)
