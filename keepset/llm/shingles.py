"""Word shingles of whole texts as sets of 64-bit hashes, and their minwise tokens."""

from __future__ import annotations

import numpy as np
import xxhash

#: A-Z lowered, and what separates words, on UTF-8 bytes.
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_CACHED_WORDS = 150_000
_known: dict[bytes, int] = {}


def words(text: bytes) -> list[bytes]:
    """A-Z lowered, cut at space and the control characters tab to carriage return."""
    return text.translate(_LOWER).split()


def _hash(word: bytes) -> int:
    if len(_known) > _CACHED_WORDS:
        _known.clear()
    _known[word] = found = xxhash.xxh3_64_intdigest(word)
    return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of ``size`` words in a row; a shorter text is one shingle, one without words none."""
    found = words(text)
    if not found:
        return np.empty(0, dtype=np.uint64)
    h = np.array([_known.get(w) or _hash(w) for w in found], dtype=np.uint64)
    size = min(size, len(h))
    n = len(h) - size + 1
    total = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        total = (total ^ h[k:k + n]) * _A + _B
        total ^= total >> np.uint64(32)
    return np.unique(_mixed(total))


def set_key(found: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart, as two signed longs."""
    digest = xxhash.xxh3_128_digest(found.tobytes())
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def minwise(found: np.ndarray, n: int) -> np.ndarray:
    """``n`` minwise tokens (the upper halves of the least of n reshuffled hashes) as signed ints."""
    out = np.empty(n, dtype=np.uint32)
    for i in range(n):
        seed = np.uint64((0xA24BAED4963EE407 * (2 * i + 1)) % (1 << 64))
        x = (found ^ seed) * (seed | np.uint64(1))
        x = (x ^ (x >> np.uint64(29))) * _B
        out[i] = (x >> np.uint64(32)).min()
    return out.view(np.int32)
