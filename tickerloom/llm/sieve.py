"""A bitmap of bounded size that lets only keys through that may be wanted; an exact join follows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """Well mixed unsigned longs, one for each of ``x``."""
    x = x + _MIX[0]
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


SIEVE_BITS = 1 << 27


def sieve(keys: DataFrame, n: int) -> np.ndarray:
    """A bitmap of the low bits of the ``n`` longs in ``keys`` (key), as bytes: 16 bits a key, as long
    as that is at most ``SIEVE_BITS`` (16 MB). A bitmap that is too small lets more through, and
    loses nothing."""
    size = min(SIEVE_BITS, 1 << max(15, (16 * n).bit_length()))
    low = keys.select((F.col("key").bitwiseAND(F.lit(size - 1)) + 1).alias("k"))
    cells = low.groupBy(F.expr("bitmap_bucket_number(k)").alias("cell")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(k))").alias("b"))
    bits = np.zeros((size // 32768, 4096), np.uint8)
    for row in cells.toLocalIterator():
        bits[row["cell"] - 1] = np.frombuffer(bytes(row["b"]), np.uint8)
    return bits.reshape(-1)


def sifted(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys may be in the sieve."""
    at = keys.view(np.uint64) & np.uint64(len(bits) * 8 - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
