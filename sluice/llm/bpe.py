"""Byte-level BPE on length-bucketed padded matrices.

Every distinct pre-token is a row of token ranks, padded to its bucket's width.
In each round every row looks its adjacent pairs up in a hashed pair table, merges
its leftmost pair of least rank, and the matrix is compacted by one column; rows
without a pair leave. Ids equal those of the ranks' reference encoder
(``encode_ordinary``); special tokens are ordinary text.

Defined cases: null text counts as empty and gives no ids; any length of text and
of pre-token is encoded whole; input columns named like an output are replaced.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sluice.llm.arrow import with_columns
from sluice.llm.segments import SegmentCache

#: Widths of the padded matrices, in bytes; longer pre-tokens merge by a heap.
WIDTHS = (2, 3, 4, 6, 8, 10, 12, 16, 24, 32, 64, 128)
#: Rows of one matrix.
ROWS = 1 << 12
#: Distinct pre-tokens a worker remembers.
WORDS_BOUND = 150_000

_NONE = np.int32(2**31 - 1)


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file: a base64 token and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}


class PairTable:
    """Open-addressed hash table from (left id, right id) to the id of their concatenation."""

    def __init__(self, left: np.ndarray, right: np.ndarray, made: np.ndarray):
        bits = max(4, int(2 * len(left) + 1).bit_length() + 1)
        self._shift, self._mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self._keys = np.full(1 << bits, -1, np.int64)
        self._made = np.full(1 << bits, _NONE, np.int32)
        keys = left.astype(np.int64) << 32 | right
        at, waiting, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(waiting):
            self.probes += 1
            free = self._keys[at[waiting]] == -1
            takers = waiting[free]
            slots, first = np.unique(at[takers], return_index=True)
            self._keys[slots], self._made[slots] = keys[takers[first]], made[takers[first]]
            waiting = waiting[self._keys[at[waiting]] != keys[waiting]]
            at[waiting] = at[waiting] + 1 & self._mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self._shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the pairs' concatenations; the largest int32 where there is none or an id is negative."""
        keys = left.astype(np.int64) << 32 | (right.astype(np.int64) & 0xFFFFFFFF)
        keys[(left < 0) | (right < 0)] = -2
        at = self._slot(keys)
        found = self._keys[at]
        out = np.where(found == keys, self._made[at], _NONE)
        open_ = np.flatnonzero((found != keys) & (found != -1) & (keys != -2))
        while len(open_):
            at[open_] = at[open_] + 1 & self._mask
            found = self._keys[at[open_]]
            same = found == keys[open_]
            out[open_[same]] = self._made[at[open_[same]]]
            open_ = open_[~same & (found != -1)]
        return out


class ByteBPE:
    """Encoder and decoder for one set of ranks and one split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self._of_byte = np.full(256, -1, np.int32)
        for b in range(256):
            self._of_byte[b] = ranks.get(bytes([b]), -1)
        if (self._of_byte < 0).any():
            raise ValueError("the ranks lack a single byte")
        parts = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self._pairs = PairTable(*(np.array(x, np.int32) for x in (zip(*parts) if parts else ((), (), ()))))
        self._bytes = {r: t for t, r in ranks.items()}
        self._words: dict[str, bytes] = {}
        self._texts = SegmentCache(self._pieces)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each pre-token."""
        out: list[bytes] = [b""] * len(words)
        buckets: dict[int, list[int]] = {}
        for k, word in enumerate(words):
            known = self.ranks.get(word)
            if known is not None:
                out[k] = known.to_bytes(4, "little")
            elif word:
                width = next((w for w in WIDTHS if w >= len(word)), 0)
                buckets.setdefault(width, []).append(k)
        for k in buckets.pop(0, ()):
            out[k] = self._merge_long(words[k])
        for width, rows in buckets.items():
            for i in range(0, len(rows), ROWS):
                self._merge_rows(width, rows[i:i + ROWS], words, out)
        return out

    def _merge_rows(self, width: int, rows: list[int], words: list[bytes], out: list[bytes]) -> None:
        padded = np.frombuffer(b"".join(words[k].ljust(width, b"\0") for k in rows), np.uint8).reshape(-1, width)
        size = np.fromiter((len(words[k]) for k in rows), np.int64, len(rows))
        ids = self._of_byte[padded]
        ids[np.arange(width) >= size[:, None]] = -1
        row = np.array(rows)
        made = self._pairs(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(row), width - 1)
        while len(row):
            at = made.argmin(1) if made.shape[1] else np.zeros(len(row), np.int64)
            best = made[np.arange(len(row)), at] if made.shape[1] else np.full(len(row), _NONE)
            done = best == _NONE
            if done.any():
                buffer, wide = ids[done].astype("<u4").tobytes(), ids.shape[1] * 4
                for i, (k, n) in enumerate(zip(row[done].tolist(), size[done].tolist())):
                    out[k] = buffer[i * wide:i * wide + 4 * n]
                ids, made, row, size, at, best = (x[~done] for x in (ids, made, row, size, at, best))
                if not len(row):
                    return
            n, each = ids.shape[1], np.arange(len(row))
            ids[each, at] = best
            keep = np.ones(ids.shape, bool)
            keep[each, at + 1] = False
            ids = ids[keep].reshape(-1, n - 1)
            size = size - 1
            keep = np.ones(made.shape, bool)
            keep[each, at] = False
            made = made[keep].reshape(-1, n - 2)
            before = np.flatnonzero(at > 0)
            if len(before):
                p = at[before] - 1
                made[before, p] = self._pairs(ids[before, p], ids[before, p + 1])
            after = np.flatnonzero(at < n - 2)
            if len(after):
                p = at[after]
                made[after, p] = self._pairs(ids[after, p], ids[after, p + 1])

    def _merge_long(self, word: bytes) -> bytes:
        """The same merges for one long pre-token, by a heap over a linked list."""
        ids = self._of_byte[np.frombuffer(word, np.uint8)].tolist()
        token = [bytes([b]) for b in word]
        n, rank = len(ids), self.ranks.get
        after, before, version = list(range(1, n + 1)), list(range(-1, n - 1)), [0] * n
        first = self._pairs(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32))
        heap = [(int(r), i, 0, 0) for i, r in enumerate(first) if r != _NONE]
        heapq.heapify(heap)
        while heap:
            r, i, mine, other = heapq.heappop(heap)
            j = after[i] if version[i] == mine else n
            if j >= n or version[j] != other:
                continue
            token[i] += token[j]
            ids[i], after[i] = r, after[j]
            version[i] += 1
            version[j] = -1
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                b = after[a] if a >= 0 else n
                if b < n and (made := rank(token[a] + token[b])) is not None:
                    heapq.heappush(heap, (made, a, version[a], version[b]))
        return np.array([ids[i] for i in range(n) if version[i] >= 0], "<u4").tobytes()

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        if len(self._words) > WORDS_BOUND:
            self._words = {}
        known, split = self._words, [self.split(p) for p in pieces]
        new = list({w for words in split for w in words if w not in known})
        known.update(zip(new, self.merge([w.encode() for w in new])))
        return [known[words[0]] if len(words) == 1 else b"".join(map(known.__getitem__, words)) for words in split]

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        return self._texts.encode(texts)

    def decode(self, ids: bytes | None) -> bytes:
        """The bytes of little-endian unsigned 32-bit ids."""
        return b"".join(map(self._bytes.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))


_coders: dict[int, ByteBPE] = {}


def _coder(shared) -> ByteBPE:
    """One coder a worker and vocabulary, so its caches outlive a task."""
    raw, pattern = shared.value
    key = hash((raw, pattern))
    if key not in _coders:
        _coders.clear()
        _coders[key] = ByteBPE(parse_ranks(raw), pattern)
    return _coders[key]


def _share(df: DataFrame, vocabulary: str, pattern: str):
    with open(vocabulary, "rb") as f:
        return df.sparkSession.sparkContext.broadcast((f.read(), pattern))



def _columns(df: DataFrame, vocabulary: str, pattern: str, source: str, targets: list[str], parts) -> DataFrame:
    shared = _share(df, vocabulary, pattern)
    return with_columns(df, [source], {t: T.BinaryType() for t in targets}, lambda: parts(_coder(shared)))


def encode(df: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with ``ids_col``: the text's ids as little-endian unsigned 32-bit integers (binary).

    ``vocabulary`` is a ``.tiktoken`` rank file on the driver; its bytes (a few MB) are broadcast.
    """
    return _columns(df, vocabulary, pattern, text_col, [ids_col], lambda coder: lambda texts: [coder.encode(texts)])


def decode(df: DataFrame, vocabulary: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``df`` with ``bytes_col``: the bytes that the ids of ``ids_col`` stand for."""
    return _columns(df, vocabulary, pattern, ids_col, [bytes_col], lambda coder: lambda ids: [list(map(coder.decode, ids))])


def round_trip(df: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` in one pass over the workers."""

    def parts(coder: ByteBPE):
        def both(texts):
            ids = coder.encode(texts)
            return [ids, list(map(coder.decode, ids))]
        return both

    return _columns(df, vocabulary, pattern, text_col, [ids_col, bytes_col], parts)
