"""Word shingles of whole texts as 64-bit hashes, computed over a batch's bytes at once."""

from __future__ import annotations

import numpy as np

SHINGLE = 5
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_SLOT = _rng.integers(0, 2**64, SHINGLE, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text, A-Z lower-cased; words are separated by ASCII white space."""
    data = np.frombuffer(text.lower(), dtype=np.uint8)
    if not len(data):
        return np.empty(0, np.uint64)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    longest = int((ends - starts).max())
    lengths = np.diff(np.concatenate([starts, [len(data)]]))  # each with the white space after it
    data, space = data[starts[0] :], space[starts[0] :]
    first = starts - starts[0]
    offset = np.arange(len(data)) - np.repeat(first, lengths)
    values = np.where(space, np.uint64(0), _BYTE[data] * _powers(longest + 1)[np.minimum(offset, longest)])
    return mix(np.add.reduceat(values, first) + (ends - starts).astype(np.uint64))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles: 5 words, or the whole sequence of fewer; none without words."""
    w = word_hashes((text or "").encode("utf-8", "surrogatepass"))
    if not len(w):
        return w
    n = max(1, len(w) - SHINGLE + 1)
    total = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(w))):
        total += w[k : k + n] * _SLOT[k]
    return np.unique(mix(total + np.uint64(min(SHINGLE, len(w)))))
