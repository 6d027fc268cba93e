"""Hashed n-gram counts and TF-IDF vectors of whole texts, by numpy over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _text as T

_TABLE = np.random.Generator(np.random.PCG64(5)).integers(1, 2**32, (8, 256), dtype=np.uint32) | np.uint32(1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] = np.arange(97, 123)
_LETTERS = np.where((_FOLD >= 128) | ((_FOLD >= 97) & (_FOLD <= 122)), _FOLD, 32).astype(np.uint8)


REPEAT_BUCKETS = 24


class Features:
    """How a text becomes counts in 2**log_dim buckets: byte n-grams, and on wish words as shapes and repeats.

    ``fold`` lower-cases A-Z first. ``letters`` does so too and keeps only n-grams of letters and single gaps between
    them, any other ASCII being a gap. ``style`` adds, for each word divided by white space, its shape (runs of upper
    case, lower case, digits, other), and whether it is the word before or the one before that once more.
    """

    def __init__(self, log_dim: int = 12, orders: tuple[int, ...] = (1, 2, 3), fold: bool = True, style: bool = False, letters: bool = False) -> None:
        self.log_dim, self.orders, self.fold, self.style, self.letters = log_dim, tuple(orders), fold, style, letters
        self.dim = 1 << log_dim

    def counts(self, column: pa.Array) -> np.ndarray:
        """One row of counts for each text; a text's long body is added up in pieces."""
        data, offsets = T.utf8(column)
        rows = len(offsets) - 1
        out = np.zeros((rows, self.dim), np.float32)
        flat = out.reshape(-1)
        row_of = np.repeat(np.arange(rows), np.diff(offsets))
        shift = np.uint32(32 - self.log_dim)
        for at in range(0, len(data), T.PIECE):
            part = data[at : at + T.PIECE + max(self.orders) - 1]
            row = row_of[at : at + len(part)]
            codes = _LETTERS[part] if self.letters else _FOLD[part] if self.fold else part
            gap = codes == 32
            pair = gap[1:] & gap[:-1]
            for n in self.orders:
                m = min(len(part) - n + 1, T.PIECE)
                if m <= 0:
                    continue
                h = np.full(m, (n * 0x9E3779B1) % 2**32, np.uint32)
                for j in range(n):
                    h += _TABLE[j][codes[j : j + m]]
                    h ^= h >> np.uint32(15)
                    h *= np.uint32(0x85EBCA6B)
                whole = row[:m] == row[n - 1 : n - 1 + m]
                if self.letters:
                    if n == 1:
                        whole = whole & ~gap[:m]
                    for j in range(n - 1):
                        whole = whole & ~pair[j : j + m]
                low = int(row[0]) * self.dim
                index = row[:m].astype(np.int64) * self.dim - low + (h >> shift)
                got = np.bincount(index[whole])
                flat[low : low + len(got)] += got
        if self.style and len(data):
            self._style(data, offsets, out)
        return out

    def _style(self, data: np.ndarray, offsets: np.ndarray, out: np.ndarray) -> None:
        s, e, h, first = T.words(data, offsets, T.NONSPACE)
        if not len(s):
            return
        kind = np.full(256, 3, np.int64)
        kind[97:123] = kind[128:] = 0
        kind[65:91], kind[48:58] = 1, 2
        total = np.zeros((4, len(data) + 1), np.int32)
        for k in range(4):
            np.cumsum(kind[data] == k, out=total[k, 1:])
        parts = np.minimum(total[:, e] - total[:, s], np.array([[3], [3], [2], [3]])).astype(np.int64)
        repeats = np.zeros(len(s), bool)
        shape = parts[0] + 4 * parts[1] + 16 * parts[2] + 48 * parts[3]
        row = np.searchsorted(first, np.arange(len(s)), "right") - 1
        for back in (1, 2):
            same = np.zeros(len(s), np.int64)
            same[back:] = (h[back:] == h[:-back]) & (row[back:] == row[:-back])
            shape = shape * 2 + same
            repeats |= same > 0
        bucket = (T.mix((shape + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.log_dim)).astype(np.int64)
        got = np.bincount(row * self.dim + bucket, minlength=out.size)
        out += got.reshape(out.shape) * np.float32(max(self.orders))
        again = np.bincount(row[repeats], minlength=len(out)).astype(np.float32)
        out[:, : 2 * REPEAT_BUCKETS : 2] += again[:, None]  # spread, so that repetition weighs like a family of n-grams


def tfidf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of unit length, or zero: (1 + log count) times idf."""
    x = np.log1p(counts, out=counts)
    x *= idf
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    x /= np.where(norm > 0, norm, 1)[:, None]
    return x


def idf(texts: DataFrame, features: Features) -> np.ndarray:
    """Inverse document frequencies over all rows of ``text``: each task sends one count per bucket in use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(features.dim, np.int64), 0
        for batch in T.slices(batches, most=1 << 20):
            df += (features.counts(batch.column(0)) > 0).sum(axis=0)
            n += len(batch)
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(df[used], n))], names=["bucket", "df"])

    rows = texts.select("text").mapInArrow(run, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df")).collect()
    counts = {r[0]: r[1] for r in rows}
    n = counts.pop(-1, 0)
    out = np.full(features.dim, np.log(1 + n), np.float32)
    for bucket, df in counts.items():
        out[bucket] = np.log((1 + n) / (1 + df)) + 0.1
    return out
