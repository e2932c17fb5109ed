"""Word shingles of whole texts as sets of 64-bit hashes, for operators that run in Python tasks."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words per shingle.
WIDTH = 5

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def _finish(x: np.ndarray) -> np.ndarray:
    """Spread every bit, so that any bits of a hash can pick a partition or an order."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes of a text.

    Words are maximal runs of other characters than the space and \\x09 to
    \\x0D, with A to Z in lower case. Fewer than five words are one shingle;
    null or wordless texts have none.
    """
    if not text:
        return np.empty(0, dtype=np.uint64)
    words = text.encode().lower().split()  # on bytes, both touch ASCII only
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    with np.errstate(over="ignore"):
        if len(h) < WIDTH:
            return _finish(np.array([(h * _FACTORS[: len(h)]).sum() + np.uint64(len(h))], dtype=np.uint64))
        total = np.zeros(len(h) - WIDTH + 1, dtype=np.uint64)
        for k in range(WIDTH):
            total += h[k : len(h) - WIDTH + 1 + k] * _FACTORS[k]
    return np.unique(_finish(total))


def set_key(shingles: np.ndarray) -> int:
    """A signed 64-bit key of a set; equal sets have equal keys."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)
