"""Bitmaps of hashes with a bounded size: a filter that may let too much through, but loses nothing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each hash, and bits at most (16 MB) whatever the number of hashes.
PER_HASH, MOST = 16, 1 << 27
_WORD = 1 << 15


def bits_of(hashes: DataFrame, per_hash: int = PER_HASH, most: int = MOST) -> np.ndarray:
    """The bitmap of a written table ``h`` of evenly spread 64-bit hashes. Spark sets the bits; the driver only joins the words."""
    size = -(-min(most, max(_WORD, per_hash * hashes.count())) // _WORD) * _WORD
    at = F.pmod("h", F.lit(size))
    words = hashes.groupBy((at / _WORD).cast("long").alias("w")).agg(F.bitmap_construct_agg(at % _WORD).alias("bits"))
    out = np.zeros((size // _WORD, _WORD // 8), dtype=np.uint8)
    for r in words.toLocalIterator():
        out[r["w"]] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    return out.ravel()


def has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes have their bit set."""
    at = np.asarray(hashes).view(np.int64) % (8 * len(bits))
    return (bits[at >> 3] >> (at & 7) & 1).astype(bool)
