"""Token counts by a unigram vocabulary, without making the tokens.

An Aho-Corasick automaton lists the vocabulary matches that end at each
character; a dynamic program carries the best score and its number of pieces.
Ties go as in the tokenizer: of equal scores, the match that starts earliest
wins.  A character that is no piece costs the lowest score less 10; with byte
fallback it counts as its UTF-8 bytes, else a run of such characters counts as
one unknown piece.

A text gets one ``▁`` in front and ``▁`` for each space.  No piece goes over
the start of a run of ``▁`` or over a newline (checked when the vocabulary is
loaded, else whole texts are one unit), so units between these are counted on
their own and remembered.  A null or empty text has no tokens.  Repeated rows
each get their row; a null ``doc_id`` stays null.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_null, rows_of

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Units that a worker remembers; it starts anew beyond that.
REMEMBERED = 500_000

_UNIT = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
_WITHIN = re.compile(f"{SPACE}*[^{SPACE}\n]*")
_SCHEMA = "doc_id long, n_chars long, n_tokens long, n_unknown long, score double"


class Vocabulary:
    """Pieces with their scores."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True):
        import ahocorasick

        self.byte_fallback = byte_fallback
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece and not self.automaton.exists(piece):
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.units = _UNIT if all(_WITHIN.fullmatch(p) for p, _ in pieces) else re.compile(r"[\s\S]+")
        self.known: dict[str, tuple[int, int, float]] = {}

    @classmethod
    def from_sentencepiece(cls, path: str) -> Vocabulary:
        """The ordinary pieces of a model file, with the scores it has."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
        ids = range(model.vocab_size())
        pieces = [(model.id_to_piece(i), model.get_score(i)) for i in ids if not special(i)]
        return cls(pieces, byte_fallback=any(model.is_byte(i) for i in ids))

    def count_unit(self, unit: str) -> tuple[int, int, float]:
        """Pieces, unknown characters and score of the best segmentation."""
        n = len(unit)
        score, pieces, unknown = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        after_unknown = [False] * (n + 1)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        if len(self.automaton):
            for last, match in self.automaton.iter(unit):
                ends[last + 1].append(match)
        for end in range(1, n + 1):
            best, start, single = 0.0, -1, False
            for length, own in ends[end]:
                at = end - length
                total = own + score[at]
                single |= length == 1
                if start < 0 or total > best or total == best and at < start:
                    best, start = total, at
            by_unknown = False
            if not single:
                total = self.unknown + score[end - 1]
                if start < 0 or total > best:
                    best, start, by_unknown = total, end - 1, True
            score[end], after_unknown[end] = best, by_unknown
            unknown[end] = unknown[start] + by_unknown
            if not by_unknown:
                pieces[end] = pieces[start] + 1
            elif self.byte_fallback:
                pieces[end] = pieces[start] + len(unit[start].encode())
            else:
                pieces[end] = pieces[start] + (not after_unknown[start])
        return pieces[n], unknown[n], score[n]

    def count(self, text: str) -> tuple[int, int, float]:
        if not text:
            return 0, 0, 0.0
        known, total = self.known, [0, 0, 0.0]
        units = self.units.findall(SPACE + text.replace(" ", SPACE))
        for unit, times in Counter(units).items():
            if (found := known.get(unit)) is None:
                found = self.count_unit(unit)
                if len(unit) <= 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[unit] = found
            total[0] += times * found[0]
            total[1] += times * found[1]
            total[2] += times * found[2]
        return total[0], total[1], total[2]


_LOADED: dict[Callable[[], Vocabulary], Vocabulary] = {}


def token_counts(docs: DataFrame, vocabulary: Callable[[], Vocabulary]) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: code points, tokens, unknown
    characters and the score.  ``vocabulary`` makes the vocabulary, once in
    each worker."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if vocabulary not in _LOADED:
            _LOADED[vocabulary] = vocabulary()
        words = _LOADED[vocabulary]
        for rows in rows_of(frames, "doc_id", "text"):
            out = [(i, len(t), *words.count(t)) for i, t in ((i, "" if is_null(t) else t) for i, t in rows)]
            columns = ["doc_id", "n_chars", "n_tokens", "n_unknown", "score"]
            yield pd.DataFrame(out, columns=columns).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(count, _SCHEMA)
