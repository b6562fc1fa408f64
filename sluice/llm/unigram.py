"""Token counts under a unigram vocabulary, without building the tokens.

An Aho-Corasick automaton lists, for every end position, the vocabulary entries that
end there; dynamic programming over positions carries only the best score and the
number of pieces on the best path. Ties follow the usual unigram lattice: paths are
extended from the left, and a later path replaces an earlier one only if its score is
greater, so of equal paths into a position the one with the longest last piece stays.
Characters that no entry covers cost the least score less UNKNOWN_PENALTY and count
as their UTF-8 bytes (byte fallback).

White space becomes the mark U+2581 and one mark is put before the text. An entry
that holds a mark after another character would cross a break between words; as
vocabularies of that kind have none (it is checked), the lattice falls apart before
every mark that follows another character, and each distinct piece of text is counted
once and remembered within a bound.

Scores come with the vocabulary. Of a model whose scores are merge ranks the counts are
those of the best lattice path under these ranks, not of its own merge order.

Defined cases: null and empty text count 0; runs of spaces are kept; any length of
text is counted whole; rows are counted one by one, repeated or not; input columns named
like the output are replaced; an empty table gives an empty one.
"""

from __future__ import annotations

import ahocorasick
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sluice.llm.arrow import with_columns

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Remembered pieces a worker.
CACHE_BOUND = 300_000


class Counter:
    """Counts for one vocabulary of (piece, score)."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        pieces = {p: s for p, s in vocabulary if p}
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("an entry crosses words")
        self._unknown = min(pieces.values(), default=0.0) - UNKNOWN_PENALTY
        self._automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self._automaton.add_word(piece, (len(piece), score))
        if pieces:
            self._automaton.make_automaton()
        self._empty = not pieces
        self._cache: dict[str, int] = {}
        self._split = regex.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall

    def viterbi(self, text: str) -> tuple[float, int]:
        """Best score of a marked text and the number of its pieces."""
        n = len(text)
        score: list[float | None] = [None] * (n + 1)
        count = [0] * (n + 1)
        score[0] = 0.0
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        if not self._empty:
            for end, found in self._automaton.iter(text):
                ends[end].append(found)
        single = [False] * n
        for end, found in enumerate(ends):
            if found and min(found)[0] == 1:
                single[end] = True
        for end in range(1, n + 1):
            best, pieces = None, 0
            for length, value in sorted(ends[end - 1], reverse=True):  # from the left: the longest first
                total = score[end - length] + value
                if best is None or total > best:
                    best, pieces = total, count[end - length] + 1
            if not single[end - 1]:
                total = score[end - 1] + self._unknown
                if best is None or total > best:
                    best, pieces = total, count[end - 1] + len(text[end - 1].encode())
            score[end], count[end] = best, pieces
        return score[n], count[n]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if len(self._cache) > CACHE_BOUND:
            self._cache = {}
        known, total = self._cache, 0
        for piece in self._split(MARK + text.replace(" ", MARK)):
            n = known.get(piece)
            if n is None:
                n = known[piece] = self.viterbi(piece)[1]
            total += n
        return total


_counters: dict[int, Counter] = {}


def count_tokens(df: DataFrame, vocabulary: list[tuple[str, float]], text_col: str = "text", count_col: str = "n_tokens") -> DataFrame:
    """``df`` with the number of tokens of its text; the vocabulary (a few MB) is broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        key = hash(tuple(shared.value))
        if key not in _counters:
            _counters.clear()
            _counters[key] = Counter(shared.value)
        one = _counters[key].count
        return lambda texts: [list(map(one, texts))]

    return with_columns(df, [text_col], {count_col: T.LongType()}, make)


def vocabulary_of(model_file: str) -> list[tuple[str, float]]:
    """Ordinary pieces and scores of a sentencepiece model file (no control, unknown or byte pieces)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    usable = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))
    return [(model.id_to_piece(i), model.get_score(i)) for i in usable]
