"""Vectorised hashes of words and word shingles, shared by the similarity operators.

Words are maximal runs of anything but ASCII white space in the text's UTF-8 bytes
with A-Z lower-cased. A word's hash is a polynomial in its bytes (through a random
table) by prefix sums modulo 2**64; a shingle's hash mixes its words' hashes.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Bytes hashed at a time, so that a very long text needs no more memory than a short one.
TILE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_rng = np.random.default_rng(20240229)
_BYTES = _rng.integers(1, 2**63, 256).astype(U) * U(2) + U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.ones(max(n, TILE), U)
        known[1:] = U(base)
        np.multiply.accumulate(known, out=known)
        _powers[base] = known if len(known) <= 2 * TILE else known[:2 * TILE].copy()
    return known[:n]


_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64 bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words, and where each text's words start among them (one more entry than texts)."""
    raw = [(t or "").encode().lower() for t in texts]
    buffer = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    begins = np.cumsum([0, *[len(r) + 1 for r in raw]])
    hashes, places, at = [], [], 0
    while at < len(buffer):
        end = min(len(buffer), at + TILE)
        while not _SPACE[buffer[end - 1]]:  # a tile ends at white space; the buffer does
            more = np.flatnonzero(_SPACE[buffer[end:end + TILE]])
            end = end + int(more[0]) + 1 if len(more) else min(len(buffer), end + TILE)
        tile = buffer[at:end]
        inside = np.concatenate(([False], ~_SPACE[tile]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        sums = np.concatenate((np.zeros(1, U), np.cumsum(_BYTES[tile] * _power(_BASE, len(tile)), dtype=U)))
        hashes.append(mix((sums[ends] - sums[starts]) * _power(_INVERSE, len(tile))[starts] + (ends - starts).astype(U)))
        places.append(starts + at)
        at = end
    hashes, places = np.concatenate(hashes), np.concatenate(places)
    return hashes, np.searchsorted(places, begins)


_FACTORS = _rng.integers(1, 2**63, 64).astype(U) * U(2) + U(1)


def shingle_sets(texts: list[str | None], words: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; of a shorter text its whole word sequence; none without words."""
    hashes, bounds = word_hashes(texts)
    out = []
    n = len(hashes) - words + 1
    if n > 0:
        all_ = np.zeros(n, U)
        for j in range(words):
            all_ += hashes[j:j + n] * _FACTORS[j]
        all_ = mix(all_)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(all_[a:b - words + 1]))
        elif b > a:
            out.append(mix((hashes[a:b] * _FACTORS[words:words + b - a]).sum(keepdims=True) + U(b - a)))
        else:
            out.append(np.zeros(0, U))
    return out
