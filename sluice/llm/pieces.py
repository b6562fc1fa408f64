"""Ids of texts from a bounded table of pieces, cut, numbered and gathered by Arrow and numpy.

The public split pattern ``'s|... ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` looks at
nothing behind a match and past its end only after white space, so a text's ids are those
of its pieces if it is cut only where no match can go on: before ASCII white space that
follows a character other than white space, between a letter and an ASCII mark, and after a
line break that stands alone. Letters are those up to U+027F; what is not known for certain
from its bytes is not cut. A null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces remembered by a table, and bytes of a piece that is.
BOUND, LONGEST = 600_000, 128

_SPACE, _LETTER, _MARK, _OTHER = 1, 2, 3, 4  # 0: not known
_KINDS = np.zeros(256, np.uint8)
_KINDS[33:127] = _MARK
_KINDS[[*range(48, 58)]] = _OTHER
_KINDS[[*range(65, 91), *range(97, 123)]] = _LETTER
_KINDS[[9, 10, 11, 12, 13, 32]] = _SPACE
#: Bytes that begin a character that is no white space, whatever follows.
_BEGINS = np.zeros(256, bool)
_BEGINS[33:127] = True
_BEGINS[[*range(0xC3, 0xE1), *range(0xE4, 0xF5)]] = True


def breaks(raw: np.ndarray) -> np.ndarray:
    """Which bytes of valid UTF-8 texts, one after another, begin a piece; the texts' first bytes are to be added."""
    kind = _KINDS[raw]
    lead = np.flatnonzero(raw >= 0xC3)  # a character's last byte has its kind
    first = raw[lead]
    for low, high, more, k in ((0xC3, 0xC9, 1, _LETTER), (0xCA, 0xDF, 1, _OTHER), (0xE0, 0xE0, 2, _OTHER), (0xE4, 0xEF, 2, _OTHER), (0xF0, 0xF4, 3, _OTHER)):
        kind[lead[(first >= low) & (first <= high)] + more] = k
    signs = lead[first == 0xC3] + 1
    kind[signs[(raw[signs] == 0x97) | (raw[signs] == 0xB7)]] = _OTHER  # the signs of multiplication and division
    out = np.zeros(len(raw), bool)
    before, after = kind[:-1], kind[1:]
    out[1:] = ((before > _SPACE) & (after == _SPACE)) | ((before == _LETTER) & (after == _MARK))
    lines = np.flatnonzero(raw[:-1] == 10)
    lines = lines[out[lines]] + 1
    out[lines[_BEGINS[raw[lines]]]] = True
    return out


class PieceTable:
    """Ids for texts. ``encode_pieces`` gives for strings an array of ids of ``kind``, and each string's start and count in it.

    When the table is full, the half not used for longest goes.
    """

    def __init__(self, encode_pieces: Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray]], kind: str = "<u4", bound: int = BOUND):
        self._encode, self._bound, self._now = encode_pieces, bound, 0
        self._pieces = pa.array([], pa.large_binary())
        self._ids, self._starts, self._counts, self._used = np.zeros(0, kind), *(np.zeros(0, np.int64) for _ in range(3))

    def _gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces one after another, and the ends of each one's."""
        counts = self._counts[places]
        ends = np.cumsum(counts)
        at = np.repeat(self._starts[places] - ends + counts, counts)
        at += np.arange(len(at))
        return self._ids[at], ends

    def _forget(self) -> None:
        keep = np.flatnonzero(pc.binary_length(self._pieces).to_numpy(zero_copy_only=False) <= LONGEST)
        if len(keep) > self._bound:
            keep = np.sort(keep[np.argsort(-self._used[keep], kind="stable")[:self._bound // 2]])
        if len(keep) < len(self._pieces):
            self._ids, ends = self._gather(keep)
            self._pieces, self._used, self._counts = self._pieces.take(pa.array(keep)), self._used[keep], self._counts[keep]
            self._starts = ends - self._counts

    def _places(self, pieces: pa.Array) -> np.ndarray:
        numbered = pieces.dictionary_encode()
        found = pc.index_in(numbered.dictionary, value_set=self._pieces)
        new = numbered.dictionary.filter(found.is_null())
        places = found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(new):
            ids, starts, counts = self._encode(new.cast(pa.large_string()).to_pylist())
            places[places < 0] = np.arange(len(self._pieces), len(self._pieces) + len(new))
            self._pieces = pa.concat_arrays([self._pieces, new])
            self._starts, self._counts = np.append(self._starts, starts + len(self._ids)), np.append(self._counts, counts)
            self._ids, self._used = np.append(self._ids, ids), np.append(self._used, np.zeros(len(new), np.int64))
        self._now += 1
        self._used[places] = self._now
        return places[numbered.indices.to_numpy()]

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of each text as bytes; null counts as empty."""
        self._forget()
        held = pa.array([t or "" for t in texts], pa.large_string())
        at = np.frombuffer(held.buffers()[1], np.int64, len(held) + 1)
        if not at[-1]:
            return [b""] * len(held)
        data = held.buffers()[2]
        raw = np.frombuffer(data, np.uint8, at[-1])
        begin = breaks(raw)
        begin[at[at < len(raw)]] = True
        cuts = np.append(np.flatnonzero(begin), len(raw))
        flat, ends = self._gather(self._places(pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), data])))
        stops = np.append(0, ends)[np.searchsorted(cuts, at)] * flat.itemsize
        made, stops = flat.tobytes(), stops.tolist()
        return [made[a:b] for a, b in zip(stops, stops[1:])]
