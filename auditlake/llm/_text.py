"""Words, shingles and their fingerprints over Arrow string columns, computed on UTF-8 bytes with numpy.

A class of separators made of ASCII characters only can be tested byte by byte, since every byte of a
non-ASCII character is 0x80 or above. Fingerprints are polynomials modulo 2**64 over random byte values,
mixed at the end; equal words give equal fingerprints, and what fingerprints bring together is verified by
whoever needs certainty. Texts are worked on in pieces, so memory follows the batch and not the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
_VALUES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_VALUES[65:91] = _VALUES[97:123]  # A-Z as a-z
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 0xD6E8FEB86659FD93 | 1
PIECE = 1 << 18

#: Byte classes of the two kinds of words: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing, and [^\x20\x09-\x0D]+.
ALNUM = np.zeros(256, bool)
ALNUM[128:] = ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = True
NONSPACE = np.ones(256, bool)
NONSPACE[[32, 9, 10, 11, 12, 13]] = False


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h ^= h >> U(29)
    h = h * U(0x9FB21C651E98DF25)
    return h ^ (h >> U(32))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, kept up to the longest length seen."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, PIECE + 4096)
            for name, x in (("up", self.base), ("down", self.inverse)):
                steps = np.full(n, U(x), U)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(_BASE), _Powers(_STEP)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; a null row is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0])), offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut by rows so that each holds about ``most`` bytes of text, or one longer row."""
    for batch in batches:
        _, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < len(batch):
            end = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
            end = min(max(end, at + 1), len(batch))
            yield batch.slice(at, end - at)
            at = end


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and fingerprints of all words, A-Z taken as a-z, and the index of each row's first word (with an end)."""
    n = len(data)
    begins, ends, prints = [], [], []
    at = 0
    while at < n:
        to = min(at + PIECE, n)
        while to < n:  # a piece ends where no word runs on, or at a row's end
            gap = np.flatnonzero(~kind[data[to : to + PIECE]])
            row = offsets[np.searchsorted(offsets, to)]
            stop = to + int(gap[0]) if len(gap) else min(to + PIECE, n)
            if row <= stop:
                to = int(row)
                break
            to = stop
            if len(gap):
                break
        piece = data[at:to]
        inside = np.zeros(len(piece) + 2, bool)
        inside[1:-1] = kind[piece]
        rows = offsets[np.searchsorted(offsets, at, "right") : np.searchsorted(offsets, to)] - at
        first = inside[1:-1] & ~inside[:-2]
        last = inside[1:-1] & ~inside[2:]
        if len(rows):
            first[rows] = inside[1:-1][rows]
            last[rows - 1] = inside[1:-1][rows - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        if len(s):
            up, down = _BYTES.upto(len(piece) + 1)
            total = np.zeros(len(piece) + 1, U)
            np.cumsum(_VALUES[piece] * up[: len(piece)], out=total[1:])
            prints.append(mix((total[e] - total[s]) * down[s]))
            begins.append(s + at)
            ends.append(e + at)
        at = to
    if not begins:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, U), np.zeros(len(offsets), np.int64)
    starts = np.concatenate(begins)
    return starts, np.concatenate(ends), np.concatenate(prints), np.searchsorted(starts, offsets)


def windows(prints: np.ndarray, k: int) -> np.ndarray:
    """Fingerprint of the k words from each position on; the last k-1 positions have none. Rows are not looked at."""
    n = len(prints) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    if k <= 6:
        out, power = np.zeros(n, U), 1
        for j in range(k):
            out += prints[j : j + n] * U(power)
            power = power * _STEP % 2**64
        return mix(out)
    out = np.empty(n, U)
    for at in range(0, n, PIECE):
        part = prints[at : min(at + PIECE, n) + k - 1]
        up, down = _WORDS.upto(len(part) + 1)
        total = np.zeros(len(part) + 1, U)
        np.cumsum(part * up[: len(part)], out=total[1:])
        m = len(part) - k + 1
        out[at : at + m] = (total[k:] - total[:-k]) * down[:m]
    return mix(out)


def whole(prints: np.ndarray) -> np.ndarray:
    """One fingerprint for a row of words, with its length, apart from those of windows()."""
    h = 0
    for x in prints[::-1].tolist():
        h = (h * _STEP + x) % 2**64
    return mix(np.array([(h + 0x51ED270B * len(prints)) % 2**64], U))


def shingle_sets(prints: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct k-word shingles, ascending, end to end, and their offsets; a row of fewer words has them all as one."""
    count = np.diff(first)
    sizes = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    out = np.empty(int(offsets[-1]), U)
    shingle = windows(prints, k)
    for i in np.flatnonzero(sizes):
        a, b = offsets[i], offsets[i + 1]
        out[a:b] = shingle[first[i] : first[i] + b - a] if count[i] >= k else whole(prints[first[i] : first[i + 1]])
        out[a:b].sort()
    if not len(out):
        return out, offsets
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[offsets[:-1][sizes > 0]] = True
    kept = np.zeros(len(out) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    return out[keep], kept[offsets]


def ragged(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of the given lengths, laid end to end: the row of each cell and its place in the row."""
    ends = np.cumsum(lengths)
    row = np.repeat(np.arange(len(lengths)), lengths)
    return row, np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
