"""Sets of word shingles as 64-bit hashes, and their minwise tokens (numpy, inside tasks)."""

from __future__ import annotations

import numpy as np
import xxhash

TOKENS = 64
WORDS_KEPT = 300_000
SKETCH = 1024
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_random = np.random.default_rng(20240229)
_TIMES = _random.integers(1, 1 << 63, TOKENS, dtype=np.uint64) | np.uint64(1)
_PLUS = _random.integers(0, 1 << 63, TOKENS, dtype=np.uint64)


class WordHashes(dict):
    """64-bit hashes of words; the frequent ones stay, the number kept is bounded."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < WORDS_KEPT:
            self[word] = h
        return h


_hashes = WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles: A-Z lower-cased, words split at ASCII white space.

    A text with fewer words is one shingle; one without words has none.
    """
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, found), dtype=np.uint64, count=len(found))
    size = min(words, len(h))
    n = len(h) - size + 1
    out = np.full(n, np.uint64(size))
    for i in range(size):
        out = mixed(out * np.uint64(3) + h[i : i + n])
    return np.unique(out)


def minwise(hashes: np.ndarray) -> bytes:
    """For each of TOKENS hash functions the smallest value, as 32-bit numbers."""
    low = np.full(TOKENS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 2048):
        part = hashes[at : at + 2048, None] * _TIMES
        part += _PLUS
        part >>= np.uint64(32)
        np.minimum(low, part.min(axis=0), out=low)
    return low.astype("<u4").tobytes()


def two_bits(tokens: bytes) -> tuple[int, int]:
    """The lowest two bits of each minwise token, as two 64-bit numbers."""
    t = np.frombuffer(tokens, dtype="<u4")
    return tuple(int.from_bytes(np.packbits((t >> i & 1).astype(np.uint8)).tobytes(), "big", signed=True) for i in (0, 1))


def odd_sketch(hashes: np.ndarray) -> list[int]:
    """SKETCH bits as 64-bit numbers: whether an odd number of the set's hashes falls on the bit."""
    odd = np.bincount((hashes % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def set_keys(hashes: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that name the set."""
    with np.errstate(over="ignore"):
        a = hashes.sum(dtype=np.uint64)
        b = mixed(hashes ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def shared(a: bytes, b: bytes) -> tuple[int, int]:
    """Sizes of the intersection and the union of two packed sets."""
    x, y = np.frombuffer(a, dtype="<u8"), np.frombuffer(b, dtype="<u8")
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both, len(x) + len(y) - both
