"""Bounded bit sets over 64-bit keys: built by Spark's own bitmap aggregates, tested in tasks.

A bit set lets a scan leave out rows that cannot matter. A false bit only lets a row through, so whoever uses
one checks exactly afterwards. Its size is fixed by ``log_bits`` whatever the data: 2**24 bits are 2 MB.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

LOG_BITS = 24


def bit_set(df: DataFrame, key: str, log_bits: int = LOG_BITS) -> np.ndarray:
    """The bits of all keys of a long column, as bytes: at most 2**log_bits / 8 of them reach the driver."""
    at = F.shiftrightunsigned(F.xxhash64(F.col(key)), 64 - log_bits) + 1  # Spark numbers bits from 1
    rows = df.filter(F.col(key).isNotNull()).select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    out = np.zeros(2**log_bits // 8, np.uint8)
    for bucket, bits in rows:
        begin = (bucket - 1) * len(bits)
        part = np.frombuffer(bits, np.uint8)[: max(0, len(out) - begin)]
        out[begin : begin + len(part)] = part
    return out


def xxhash64(keys: np.ndarray, seed: int = 42) -> np.ndarray:
    """Spark's xxhash64 of a column of longs."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, r: (x << np.uint64(r)) | (x >> np.uint64(64 - r))
    k = keys.view(np.uint64)
    h = np.uint64((seed + int(p5) + 8) % 2**64) ^ (turn(k * p2, 31) * p1)
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def in_bits(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether each key's bit is set."""
    shift = np.uint64(64 - (len(bits) * 8).bit_length() + 1)
    at = xxhash64(keys) >> shift
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0
