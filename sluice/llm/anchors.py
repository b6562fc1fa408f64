"""Minimizer anchors: every LENGTH-byte window picks the k-gram of least hash in it.

Equal windows pick the same k-gram at the same place, so two documents share a
window only if they share an anchor's hash; the windows that pick an anchor are
consecutive. Ties go to the leftmost k-gram of the window.
"""

from __future__ import annotations

import numpy as np

from sluice.llm.shingles import _BASE, _BYTES, _INVERSE, U, _power, mix

LENGTH = 50
GRAM = 24
_SPAN = LENGTH - GRAM + 1
#: Bytes hashed at a time.
TILE = 1 << 19


def _tile(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each window of ``buffer``: the place of its anchor; and the hash of each k-gram."""
    sums = np.concatenate((np.zeros(1, U), np.cumsum(_BYTES[buffer] * _power(_BASE, len(buffer)), dtype=U)))
    h = mix((sums[GRAM:] - sums[:-GRAM]) * _power(_INVERSE, len(sums) - GRAM))
    least, at, reach = h, np.arange(len(h), dtype=np.int32), 1
    while reach < _SPAN:
        step = min(reach, _SPAN - reach)
        a, b = least[:-step], least[step:]
        right = b < a
        least, at = np.where(right, b, a), np.where(right, at[step:], at[:-step])
        reach += step
    return at, h


def anchors(buffer: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first window, last window, anchor, hash) of the anchors of documents that stand one after another.

    Document i is ``buffer[begins[i]:begins[i + 1]]``; no window crosses documents.
    Least hashes are small, so they are mixed once more to spread evenly.
    """
    found = []
    for start in range(0, max(0, len(buffer) - LENGTH + 1), TILE):
        tile = buffer[start:start + TILE + LENGTH - 1]
        at, h = _tile(tile)
        windows = np.arange(start, start + len(at), dtype=np.int64)
        doc = np.searchsorted(begins, windows, side="right") - 1
        whole = windows + LENGTH <= begins[doc + 1]
        windows, doc, at = windows[whole], doc[whole], at[whole]
        if not len(windows):
            continue
        new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]) | (windows[1:] != windows[:-1] + 1))))
        last = np.concatenate((new[1:], [len(windows)])) - 1
        found.append((doc[new], windows[new], windows[last], at[new].astype(np.int64) + start, mix(h[at[new]])))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0, U)
    return tuple(np.concatenate(x) for x in zip(*found))  # type: ignore[return-value]
