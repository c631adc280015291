"""Token counts of a unigram vocabulary, without the tokens.

An Aho-Corasick automaton lists every vocabulary piece in a word in one pass; dynamic programming keeps, for
each place, the best score of a way to it and how many pieces that way has, and nothing else.  Its rules
are those of the `tokenizers` library's unigram model: of equal scores at a place the longest last piece
stays; a character that is no piece costs the lowest score less ten and counts once per UTF-8 byte.

Blanks become U+2581 and words are counted one by one, each with its own in front, as the library's
Metaspace does.  Counts of words are remembered per Python worker, in two generations of bounded size.

A SentencePiece file of another kind (BPE: its scores are ranks of merges, not log-probabilities) isn't for that
method; `model_counts` gives the counts of the file's own tokenizer, whatever its kind.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import cache, partial

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import whole_text

SPACE = "\u2581"
UNKNOWN_PENALTY = 10.0
GENERATION = 300_000


def vocabulary(path: str) -> list[tuple[str, float]]:
    """The pieces and scores of a SentencePiece model, in the order of their ids."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    """text -> how many pieces its best segmentation has."""

    def __init__(self, pieces: list[tuple[str, float]], generation: int = GENERATION):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.generation = generation
        self.new: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def best(self, word: str) -> tuple[float, int]:
        """Score and piece count of the best segmentation."""
        ends: list[list] = [[] for _ in word]
        for end, match in self.automaton.iter(word):  # at one end the longest piece comes first
            ends[end].append(match)
        scores, counts = [0.0], [0]
        for end, matches in enumerate(ends):
            top, n, single = float("-inf"), 0, False
            for size, score in matches:
                value = scores[end + 1 - size] + score
                if value > top:
                    top, n = value, counts[end + 1 - size] + 1
                single |= size == 1
            if not single and scores[end] + self.unknown > top:
                top, n = scores[end] + self.unknown, counts[end] + len(word[end].encode())
            scores.append(top)
            counts.append(n)
        return scores[-1], counts[-1]

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        marked = text.replace(" ", SPACE)
        words = (marked[1:] if marked[0] == SPACE else marked).split(SPACE)
        if len(self.new) > self.generation:
            self.old, self.new = self.new, {}
        new, old, total = self.new, self.old, 0
        for n, word in zip(map(new.get, words), words, strict=True):
            if n is None and (n := new.get(word)) is None:
                if (n := old.get(word)) is None:
                    n = self.best(SPACE + word)[1]
                new[word] = n
            total += n
        return total


@cache
def counter(path: str) -> Counter:
    """This worker's counter for the SentencePiece model in path."""
    return Counter(vocabulary(path))


class ModelCounter:
    """text -> how many pieces SentencePiece's own encoder makes of it with the model in path.

    A BPE model merges pieces and nothing else: if no piece goes on with a blank after another character, no
    merge crosses the front of a run of blanks, and runs with the word behind them are encoded and
    remembered one by one.  Any other model gets whole texts.
    """

    UNIT = re.compile(f"{SPACE}+[^{SPACE}]*")

    def __init__(self, path: str, generation: int = GENERATION):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        self.encode = SentencePieceProcessor(model_file=path).encode
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        plain, spec = model.normalizer_spec, model.trainer_spec
        crossing = any(SPACE in p.piece.lstrip(SPACE) for p in model.pieces)
        defined = any(p.type == p.USER_DEFINED for p in model.pieces)
        untouched = not plain.precompiled_charsmap and not plain.remove_extra_whitespaces and plain.add_dummy_prefix and plain.escape_whitespaces
        self.by_unit = spec.model_type == spec.BPE and not spec.treat_whitespace_as_suffix and untouched and not crossing and not defined
        self.generation = generation
        self.new: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def of_unit(self, unit: str) -> int:
        """The encoder puts a blank in front, which the unit has; of an empty text it makes nothing, of one blank a piece."""
        return len(self.encode(unit[1:])) or 1

    def __call__(self, text: str) -> int:
        if not text or not self.by_unit:
            return len(self.encode(text))
        units = self.UNIT.findall(SPACE + text.replace(" ", SPACE))
        if len(self.new) > self.generation:
            self.old, self.new = self.new, {}
        new, old, total = self.new, self.old, 0
        for n, unit in zip(map(new.get, units), units, strict=True):
            if n is None and (n := new.get(unit)) is None:
                if (n := old.get(unit)) is None:
                    n = self.of_unit(unit)
                new[unit] = n
            total += n
        return total


@cache
def model_counter(path: str) -> ModelCounter:
    """This worker's counter of the tokenizer in path."""
    return ModelCounter(path)


def _rows(batches: Iterable[pa.RecordBatch], path: str, make: Callable[[str], Callable[[str], int]] = counter) -> Iterator[pa.RecordBatch]:
    count = make(path)
    for batch in batches:
        n = [count(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_tokens) over whole texts.  Null and empty texts have none; repeated rows stay, no rows give none."""
    texts = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    return texts.mapInArrow(partial(_rows, path=path), "doc_id long, n_tokens long")


def model_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_tokens) as the SentencePiece tokenizer in path counts them.  Null and empty texts have none; repeated rows stay, no rows give none."""
    texts = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    return texts.mapInArrow(partial(_rows, path=path, make=model_counter), "doc_id long, n_tokens long")
