"""Alignment of two tokenizers over the same bytes, with corpus-wide counts of linked ids.

A text is encoded by a byte-level BPE (A, of blank and text) and by a sentencepiece BPE (B, which adds the blank itself).
Each token ends at a byte. The shorter list of ends drives an exponential and then binary search into the longer; every
end starts where an earlier one was found. Ends that are in both cut the tokens into groups; differences of the ranks
found give, for each driving token, the range of tokens of the other list that overlap it: its links.

Counts: in how many rows an id pair is linked. Rows keep their distinct pairs in a stored table; tasks add up pairs
before they are shuffled. Of all pairs' counts the ``most_pairs`` highest at most are broadcast with each A id's highest
(a number for each id of the vocabulary); pairs below that level are joined.

Encoding works on stretches that begin at a blank after a printable ASCII character or one from U+00C0 to U+00FF.
Both tokenizers always split there (A by its pattern; B as no piece holds a blank after another character, which is
checked), so a stretch has the same tokens wherever it stands, and each worker keeps those that it has met
(``store_mb`` at most, then it starts anew).

Defined cases: null and empty texts, and texts whose joined tokens differ from blank and text in either tokenizer, have
no tokens: zeros and an empty digest. Repeated rows and null ids get a row each and count as rows each. Extra columns
are not read; an empty table gives no rows. Memory follows the slice (1 MB of text or one longer text).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _counts, _text as T
from .bpe import _ODD, Codec, default_tokenizer

MOST_PAIRS = 1 << 20
STORE_MB = 64
_HALF = 22  # bits of an id in a pair
_SHOWN = np.zeros(256, bool)
_SHOWN[33:127] = True


def default_pieces() -> str:
    """The file of the public 32k sentencepiece BPE that is installed beside the library."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Side:
    """Token ids and byte lengths by one tokenizer of all stretches met, end to end."""

    def __init__(self) -> None:
        self.ids, self.starts, self.counts = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = self.known = 0

    def add(self, rows: list[list[int]]) -> None:
        counts = np.fromiter(map(len, rows), np.int64, len(rows))
        total = int(counts.sum())
        for name, need in (("ids", self.used + total), ("starts", self.known + len(rows)), ("counts", self.known + len(rows))):
            old = getattr(self, name)
            if need > len(old):
                setattr(self, name, np.concatenate([old, np.zeros(max(need - len(old), len(old)), old.dtype)]))
        self.ids[self.used : self.used + total] = np.fromiter((i for r in rows for i in r), np.int32, total)
        self.starts[self.known : self.known + len(rows)] = self.used + np.cumsum(counts) - counts
        self.counts[self.known : self.known + len(rows)] = counts
        self.used += total
        self.known += len(rows)

    def of(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the stretches in order, and how many each has."""
        counts = self.counts[units]
        cell, place = T.ragged(counts)
        return self.ids[self.starts[units][cell] + place], counts


class Tokens(NamedTuple):
    """Of texts laid end to end: ids, ends in bytes, and where each text's tokens begin (with an end)."""

    ids: np.ndarray
    ends: np.ndarray
    first: np.ndarray


class Pair:
    """Both tokenizers, and the stretches that this worker has met."""

    _made: dict = {}

    @classmethod
    def of(cls, path_a: str, path_b: str, store_mb: int) -> Pair:
        key = (path_a, path_b, store_mb)
        if key not in cls._made:
            cls._made[key] = cls(*key)
        return cls._made[key]

    def __init__(self, path_a: str, path_b: str, store_mb: int) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        codec = Codec.of(path_a)
        self.fast = codec.fast
        self.slow = Tokenizer.from_file(path_a)
        self.slow.no_truncation()
        self.slow.no_padding()
        self.slow.encode_special_tokens = True
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        shown = [self.pieces.id_to_piece(i) for i in range(self.pieces.vocab_size())]
        if any("▁" in p.lstrip("▁") for p in shown) or len(self.pieces.encode("a")) != 1:
            raise ValueError("pieces must hold blanks at their beginning only, and 'a' must be one piece")
        self.bytes_a = codec.bytes
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(shown)]
        self.length_a, self.length_b = (np.array([len(x) for x in b], np.int64) for b in (self.bytes_a, self.bytes_b))
        if max(len(self.bytes_a), len(self.bytes_b)) > 1 << _HALF:
            raise ValueError("too many ids")
        self.most = store_mb << 20
        self.clear()

    def clear(self) -> None:
        self.units: dict[bytes, int] = {}
        self.a, self.b, self.good, self.held = Side(), Side(), np.zeros(0, bool), 0

    def _meet(self, new: list[bytes]) -> None:
        texts = [u.decode() for u in new]
        rows_a = [self.slow.encode(t, add_special_tokens=False).ids if self.fast is None or _ODD.search(u) else self.fast.encode_ordinary(t) for u, t in zip(new, texts, strict=True)]
        rows_b = [r[1:] for r in self.pieces.encode(["a" + t for t in texts], num_threads=1)]  # the stretch as it stands after a word
        good = [b"".join([self.bytes_a[i] for i in x]) == u == b"".join([self.bytes_b[i] for i in y]) for u, x, y in zip(new, rows_a, rows_b, strict=True)]
        self.a.add(rows_a)
        self.b.add(rows_b)
        self.good = np.concatenate([self.good, np.array(good, bool)])
        for u in new:
            self.units[u] = len(self.units)
            self.held += len(u) + 160
        self.held += 4 * sum(map(len, rows_a)) + 4 * sum(map(len, rows_b))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, Tokens, Tokens]:
        """Whether each text has tokens, and the tokens of those that have, in both tokenizers."""
        some = np.diff(offsets) > 0
        raw = np.insert(data, offsets[:-1][some], 32)
        begins = np.concatenate([[0], np.cumsum((np.diff(offsets) + 1)[some])])
        cut = np.zeros(len(raw) + 1, bool)
        if len(raw) > 2:
            cut[2:-1] = (raw[2:] == 32) & (_SHOWN[raw[1:-1]] | ((raw[1:-1] >= 0x80) & (raw[:-2] == 0xC3)))
            cut[1] = (raw[1] == 32) & _SHOWN[raw[0]]
        cut[begins] = True
        cuts = np.flatnonzero(cut)
        if self.held > self.most:
            self.clear()
        whole, places = raw.tobytes(), cuts.tolist()
        parts = [whole[x:y] for x, y in zip(places[:-1], places[1:], strict=True)]
        if new := list(dict.fromkeys(p for p in parts if p not in self.units)):
            self._meet(new)
        units = np.fromiter(map(self.units.__getitem__, parts), np.int64, len(parts))
        row = np.searchsorted(begins, cuts[:-1], "right") - 1
        n = len(begins) - 1
        fine = np.ones(n, bool)
        for r in np.unique(row[~self.good[units]]).tolist():
            own = units[row == r]
            text = whole[begins[r] : begins[r + 1]]
            fine[r] = all(b"".join([held[i] for i in side.of(own)[0].tolist()]) == text for side, held in ((self.a, self.bytes_a), (self.b, self.bytes_b)))
        units, row = units[fine[row]], row[fine[row]]
        has = some.copy()
        has[some] = fine
        order = np.cumsum(fine) - 1
        out = []
        for side, length in ((self.a, self.length_a), (self.b, self.length_b)):
            ids, counts = side.of(units)
            per = np.bincount(order[row], weights=counts, minlength=int(fine.sum())).astype(np.int64)
            out.append(Tokens(ids, np.cumsum(length[ids]), np.concatenate([[0], np.cumsum(per)])))
        return has, *out


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each of the ascending values of ``short``, the first place in ``long`` that is not below it.

    The first value gallops from the start; then, at ever finer steps, each value from where the one before it was
    found: strides double until they pass it, and the last stride is halved down to the place. ``long`` must reach
    the last value.
    """
    at = np.zeros(len(short), np.int64)

    def search(index: np.ndarray, low: np.ndarray) -> None:
        key, high, stride = short[index], low.copy(), 1
        live = np.flatnonzero(long[high] < key)
        while len(live):
            low[live] = high[live] + 1
            high[live] = np.minimum(high[live] + stride, len(long) - 1)
            stride *= 2
            live = live[long[high[live]] < key[live]]
        live = np.flatnonzero(low < high)
        while len(live):
            middle = (low[live] + high[live]) >> 1
            below = long[middle] < key[live]
            low[live] = np.where(below, middle + 1, low[live])
            high[live] = np.where(below, high[live], middle)
            live = live[low[live] < high[live]]
        at[index] = low

    if len(short):
        search(np.zeros(1, np.int64), np.zeros(1, np.int64))
        step = 1 << (len(short) - 1).bit_length()
        while step := step >> 1:
            index = np.arange(step, len(short), 2 * step)
            search(index, at[index - step].copy())
    return at


class Aligned(NamedTuple):
    """Which tokens end a group, and all links as places in both lists, with the text of each."""

    cut_a: np.ndarray
    cut_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    row: np.ndarray


def align(a: Tokens, b: Tokens) -> Aligned:
    """Common ends and overlaps of both lists of every text."""
    per_a, per_b = np.diff(a.first), np.diff(b.first)
    cuts, links = (np.zeros(len(a.ids), bool), np.zeros(len(b.ids), bool)), []
    for turn, drives in ((0, per_a <= per_b), (1, per_a > per_b)):
        own, other = (a, b) if turn == 0 else (b, a)
        row = np.repeat(np.arange(len(drives)), np.diff(own.first))
        index = np.flatnonzero(drives[row])
        if not len(index):
            continue
        row = row[index]
        to = gallop(own.ends[index], other.ends)
        same = other.ends[to] == own.ends[index]
        cuts[turn][index[same]] = True
        cuts[1 - turn][to[same]] = True
        since = np.empty(len(index), np.int64)  # the first token of the other list that ends after this one begins
        since[1:] = to[:-1] + same[:-1]
        fresh = index == own.first[row]
        since[fresh] = other.first[row[fresh]]
        cell, place = T.ragged(to - since + 1)
        ranks = index[cell], since[cell] + place
        links.append((ranks[turn], ranks[1 - turn], row[cell]))
    if not links:
        none = np.zeros(0, np.int64)
        return Aligned(*cuts, none, none, none)
    return Aligned(*cuts, *(np.concatenate(x) for x in zip(*links, strict=True)))


@lru_cache
def _digits(width: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of all numbers of up to ``width`` digits, right-aligned, and how many each has."""
    ids = np.arange(10**width)
    return (ids[:, None] // 10 ** np.arange(width - 1, -1, -1) % 10 + 48).astype(np.uint8), np.searchsorted(10 ** np.arange(1, width), ids, "right") + 1


def group_texts(a: Tokens, b: Tokens, cut_a: np.ndarray, cut_b: np.ndarray) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of every text."""
    end_a, end_b = np.flatnonzero(cut_a) + 1, np.flatnonzero(cut_b) + 1
    group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    n = len(a.ids) + len(b.ids)
    ids, mark = np.empty(n, np.int64), np.empty(n, np.uint8)
    place_a = np.arange(len(a.ids)) + np.concatenate([[0], end_b])[group_a]
    place_b = np.arange(len(b.ids)) + end_a[group_b]
    ids[place_a], mark[place_a] = a.ids, np.where(cut_a, ord("|"), ord(","))
    ids[place_b], mark[place_b] = b.ids, np.where(cut_b, ord(";"), ord(","))
    width = len(str(int(ids.max(initial=0))))
    digits, sizes = _digits(width)
    shown = np.empty((n, width + 1), np.uint8)
    shown[:, :-1] = digits[ids]
    shown[:, -1] = mark
    size = sizes[ids]
    keep = np.arange(width + 1) >= (width - size)[:, None]
    flat = shown[keep].tobytes()
    ends = np.concatenate([[0], np.cumsum(size + 1)])[a.first + b.first].tolist()
    return [flat[x : y - 1] for x, y in zip(ends[:-1], ends[1:], strict=True)]


def _lists(values: np.ndarray, kind: pa.DataType, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def link(docs: DataFrame, tokenizer: str | None = None, pieces: str | None = None, id_col: str = "doc_id", text_col: str = "text", store_mb: int = STORE_MB) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups_sha256, a, b, times`` of every row: its distinct linked id pairs and how often each is linked."""
    paths = tokenizer or default_tokenizer(), pieces or default_pieces()
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Pair.of(*paths, store_mb)
        for batch in T.slices(batches, most=1 << 20):
            has, a, b = both.encode(*T.utf8(batch.column(1)))
            x = align(a, b)
            n, rows = len(a.first) - 1, np.flatnonzero(has)
            key, times = np.unique((x.row << 2 * _HALF) | (a.ids[x.link_a].astype(np.int64) << _HALF) | b.ids[x.link_b], return_counts=True)
            digest = [""] * len(batch)
            for r, text in zip(rows.tolist(), group_texts(a, b, x.cut_a, x.cut_b), strict=True):
                digest[r] = hashlib.sha256(text).hexdigest()

            def spread(values: np.ndarray) -> pa.Array:
                out = np.zeros(len(has), np.int64)
                out[rows] = values
                return pa.array(out)

            groups = np.bincount(np.repeat(np.arange(n), np.diff(a.first))[x.cut_a], minlength=n)
            size = np.zeros(len(has), np.int64)
            size[rows] = np.bincount(key >> 2 * _HALF, minlength=n)
            offsets = np.concatenate([[0], np.cumsum(size)])
            low = (1 << _HALF) - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), spread(np.diff(a.first)), spread(np.diff(b.first)), spread(groups), spread(np.bincount(x.row, minlength=n)), pa.array(digest, pa.string()), _lists(((key >> _HALF) & low).astype(np.int32), pa.int32(), offsets), _lists((key & low).astype(np.int32), pa.int32(), offsets), _lists(times.astype(np.int32), pa.int32(), offsets)],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b", "times"],
            )

    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, times array<int>")


def _pairs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The packed pairs of a batch's columns a and b, and how many each row has."""
    a, b = (batch.column(batch.schema.get_field_index(x)) for x in "ab")
    return (a.flatten().to_numpy(zero_copy_only=False).astype(np.int64) << _HALF) | b.flatten().to_numpy(zero_copy_only=False), np.diff(a.offsets.to_numpy())


def pair_counts(linked: DataFrame, most: int = 1 << 21) -> DataFrame:
    """``pair, n``: in how many rows of ``linked`` each id pair stands (pair: A id times 2**22, and B id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, n in _counts.added((_pairs(batch)[0] for batch in batches), most):
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["pair", "n"])

    return linked.select("a", "b").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def alignment(docs: DataFrame, tokenizer: str | None = None, pieces: str | None = None, id_col: str = "doc_id", text_col: str = "text", most_pairs: int = MOST_PAIRS, store_mb: int = STORE_MB) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row.

    ``n_best``: links whose pair's count is the highest that its A id has anywhere; ``count_sum``: counts over links.
    """
    spark = docs.sparkSession
    linked = _counts.stored(link(docs, tokenizer, pieces, id_col, text_col, store_mb).withColumn("row", F.monotonically_increasing_id()), "linked")
    counts = _counts.stored(pair_counts(linked), "pair-counts")
    tops = counts.groupBy(F.shiftright("pair", _HALF).cast("int").alias("a")).agg(F.max("n").alias("top"))  # a row for each id of the vocabulary at most
    sent, rest = _counts.split(counts, "n", most_pairs)
    table, top = sent.select("pair", "n").toArrow(), tops.toArrow()
    keys, ns = (table.column(x).to_numpy() for x in ("pair", "n"))
    order = np.argsort(keys)
    best = np.zeros(int(max(top.column("a").to_numpy(), default=-1)) + 1, np.int64)
    best[top.column("a").to_numpy()] = top.column("top").to_numpy()
    shared = spark.sparkContext.broadcast((keys[order], ns[order], best))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n_of, best = shared.value
        for whole in batches:
            for at in range(0, len(whole), 1000):
                batch = whole.slice(at, 1000)
                key, per = _pairs(batch)
                times = batch.column(batch.schema.get_field_index("times")).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(len(batch)), per)
                own, turn = np.unique(key, return_inverse=True)
                place = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
                met = known[place] == own if len(known) else np.zeros(len(own), bool)
                n = np.zeros(len(own), np.int64)
                n[met] = n_of[place[met]]
                lead = met & (n == best[own >> _HALF])
                total, leading = (np.zeros(len(batch), np.int64) for _ in range(2))
                np.add.at(total, row, times * n[turn])
                np.add.at(leading, row, times * lead[turn])
                missed = ~met[turn]
                offsets = np.concatenate([[0], np.cumsum(np.bincount(row[missed], minlength=len(batch)))])
                yield pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array(leading), pa.array(total), _lists(key[missed], pa.int64(), offsets), _lists(times[missed], pa.int64(), offsets)], names=[*batch.schema.names[:-3], "n_best", "count_sum", "pairs", "often"])

    heads = linked.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "row", "a", "b", "times")
    kind = heads.schema["doc_id"].dataType.simpleString()
    scored = _counts.stored(heads.mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, row long, n_best long, count_sum long, pairs array<long>, often array<long>"), "scored")
    missed = scored.select("row", F.explode(F.arrays_zip("pairs", "often")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.often").alias("times"))
    joined = missed.join(rest, "pair").withColumn("a", F.shiftright("pair", _HALF).cast("int")).join(F.broadcast(tops), "a")
    more = joined.groupBy("row").agg(F.sum(F.when(F.col("n") == F.col("top"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more_sum"))
    added = lambda x, y: (F.col(x) + F.coalesce(F.col(y), F.lit(0))).alias(x)
    return scored.join(more, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", added("n_best", "more_best"), added("count_sum", "more_sum"), "groups_sha256")
