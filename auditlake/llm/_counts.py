"""Exact counts of keys that may be any number: the most frequent are sent to all workers, the rest meet their rows in joins.

Which keys are sent follows from a histogram of all counts, so ``most`` bounds what is broadcast whatever the data.
Keys below that level are rarer than all that are sent, so none of them is hot; they are joined by shuffles.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..shared import scratch_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder in a dense form, and read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def level(n: str) -> Column:
    """Eight levels for each doubling of a count."""
    return F.floor(F.log2(n) * 8).cast("int")


def split(counts: DataFrame, n: str, most: int) -> tuple[DataFrame, DataFrame]:
    """Rows of the highest levels, ``most`` at most, and all others."""
    held, least = 0, 8 * 64
    for step, rows in sorted(((r[0], r[1]) for r in counts.groupBy(level(n)).count().collect()), reverse=True):  # 504 levels at most
        held += rows
        if held > most:
            break
        least = step
    return counts.filter(level(n) >= least), counts.filter(level(n) < least)


def added(batches: Iterable[np.ndarray], most: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct keys and how often each comes, added up as long as no more than ``most`` keys are held."""
    keys, n, waiting, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add() -> tuple[np.ndarray, np.ndarray]:
        own, turn = np.unique(np.concatenate([keys, *waiting]), return_inverse=True)
        return own, np.bincount(turn, weights=np.concatenate([n, np.ones(size)]), minlength=len(own)).astype(np.int64)

    for batch in batches:
        waiting.append(batch)
        size += len(batch)
        if size >= most:
            keys, n = add()
            waiting, size = [], 0
            if len(keys) >= most:
                yield keys, n
                keys, n = keys[:0], n[:0]
    yield add()
