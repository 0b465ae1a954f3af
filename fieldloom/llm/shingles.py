"""Word shingles as 64-bit hashes, for batches of texts."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words in a shingle.
SPAN = 5
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def words(text: str) -> list[bytes]:
    """Runs of other characters than space and U+0009 to U+000D, with A-Z lower-cased."""
    return text.encode("utf-8", "replace").lower().split()


def hash_words(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(h: np.ndarray, span: int = SPAN) -> np.ndarray:
    """The shingle that starts at each word but the last span - 1; of fewer words, all of them as one; none of none."""
    n = len(h)
    if n == 0:
        return np.zeros(0, np.uint64)
    if n < span:
        return _finish((h * _MIX[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
    out = h[: n - span + 1] * _MIX[0]
    for k in range(1, span):
        out = out + h[k : n - span + 1 + k] * _MIX[k]
    return _finish(out)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct shingles of a whole text; of null, none."""
    return np.unique(spans(hash_words(words(text)))) if text else np.zeros(0, np.uint64)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())
