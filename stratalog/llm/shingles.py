"""Words, shingles and their hashes, in Python workers.

Words are runs of characters other than space and \\x09-\\x0D, A-Z lower-cased; a document's set holds
its distinct shingles of a number of words, or its whole sequence as one if it has fewer words, or
nothing if it has no word. A shingle stands as a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import xxhash

#: Odd multipliers that mix the hashes of a shingle's words.
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def words(text: bytes | None) -> list[bytes]:
    """bytes.lower and bytes.split know ASCII only, which is what is asked for."""
    return text.lower().split() if text else []


def hashes(found: Sequence[bytes | str]) -> np.ndarray:
    one = xxhash.xxh3_64_intdigest
    return np.fromiter([one(w) for w in found], np.uint64, len(found))


def rolling(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of size words, from the hashes of the words; of the whole if there are fewer."""
    size = min(size, len(h))
    if not size:
        return h
    n = len(h) - size + 1
    g = h[:n] * _MIX[0]
    for k in range(1, size):
        g = (g ^ (g >> np.uint64(29))) * _MIX[4] + h[k : n + k] * _MIX[1 + k % 3]
    g = (g ^ (g >> np.uint64(32))) * _MIX[0]
    return g ^ (g >> np.uint64(29))


def shingle_set(text: bytes | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes."""
    return np.unique(rolling(hashes(words(text)), size))
