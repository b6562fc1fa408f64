"""Shared by the tokenizing operators: a bounded cache over space-delimited segments.

A byte-level pre-tokenizer with the pattern ``'s|... ?\\p{L}+ ... \\s+(?!\\S)|\\s+``
always breaks before a space whose neighbours are not white space, so a text can
be cut at its single spaces, each piece encoded once, and the results joined.
Texts in which a space touches other white space are encoded as one piece. A null text
counts as empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

#: Cached pieces of each of a worker's two generations.
CACHE_BOUND = 100_000

class SegmentCache:
    """Bytes for texts, encoded piece by piece. ``encode_pieces`` maps whole strings to bytes.

    The cache has two generations: when the younger is full the older goes, and pieces
    still in use come over. With ``parts``, a piece of letters and digits with a full stop
    or comma after them is made of both parts' bytes, as the pattern breaks there too.
    """

    def __init__(self, encode_pieces: Callable[[list[str]], list[bytes]], bound: int = CACHE_BOUND, parts: bool = False):
        self._encode, self._bound, self._parts = encode_pieces, bound, parts
        self._first: dict[str, bytes | None] = {}
        self._rest: dict[str, bytes | None] = {}  # by the piece without its leading space
        self._old: dict[str, bytes | None] = {}
        self._ends: dict[str, bytes] = {}

    def _split(self, pieces: list[str]) -> tuple[list[str], list[tuple[str, str, str]]]:
        """Pieces to encode as they are, and (piece, word, end) of those that have parts."""
        parted = [(p, p[:-1], p[-1]) for p in pieces if p[-1] in ".," and p[:-1].isalnum()]
        return list(set(pieces).difference([p for p, _, _ in parted])) if parted else pieces, parted

    def _learn(self, known: dict, pieces: set[str], lead: str) -> None:
        new = pieces.difference(known)
        if lead and self._old:
            old = new.intersection(self._old)
            known.update((p, self._old[p]) for p in old)
            new.difference_update(old)
        plain = [p for p in new if p and not p[0].isspace() and not p[-1].isspace()]
        if len(plain) < len(new):
            known.update(dict.fromkeys(new.difference(plain)))
        if not lead:
            known.update(zip(plain, self._encode(plain)))
            return
        parted: list[tuple[str, str, str]] = []
        if self._parts:
            plain, parted = self._split(plain)
            words = {w for _, w, _ in parted}
            plain = list(words.difference(known).union(plain))
            ends = list({e for _, _, e in parted}.difference(self._ends))
            self._ends.update(zip(ends, self._encode(ends)))
        known.update(zip(plain, self._encode([lead + p for p in plain])))
        known.update((p, known[w] + self._ends[e]) for p, w, e in parted)

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """The bytes of each text; null counts as empty."""
        if len(self._rest) > self._bound:
            self._old, self._rest, self._first = self._rest, {}, {}
        split = [(text or "").split(" ") for text in texts]
        firsts = [pieces.pop(0) if pieces else "" for pieces in split]
        self._learn(self._first, set(firsts), "")
        seen: set[str] = set()
        for pieces in split:
            seen.update(pieces)
        self._learn(self._rest, seen, " ")
        first, rest, out, whole = self._first, self._rest.__getitem__, [], []
        for k, pieces in enumerate(split):
            if firsts[k] == "" and not pieces:
                out.append(b"")
                continue
            try:
                out.append(first[firsts[k]] + b"".join(map(rest, pieces)))
            except TypeError:  # a piece that needs its neighbours
                out.append(b"")
                whole.append(k)
        if whole:
            made = self._encode([" ".join([firsts[k], *split[k]]) for k in whole])
            for k, ids in zip(whole, made):
                out[k] = ids
        return out
