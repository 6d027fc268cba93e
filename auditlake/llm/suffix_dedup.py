"""Repeated passages by sparse suffix arrays.

A word of a document is *repeated* when some window of ``min_words`` words around it also occurs earlier: in a
document of smaller id, or earlier in the same document. So the first occurrence of a passage stays whole and all
later ones are covered, exactly; passages under ``min_words`` words are never touched.

1. Suffixes are retained only at minimisers: of each ``WINDOW`` successive ``K``-word shingles the least (leftmost)
   fingerprint. Equal windows of ``min_words`` words hold the same minimiser at the same place. A suffix carries its
   words to the right, and those before it to the left, as far as windows rely on it: one byte of each word's
   fingerprint (suffixes sort by these codes instead of letters; equal words stand together either way).
2. The suffixes are sorted over the cluster by their codes, then by document and place. Ranges split between equal
   suffixes too, so one passage that a third of all rows share does not land in one task.
3. Neighbours in that order are compared and extended: to the right by their common prefix, to the left within a run of
   equal leading words by the order of what stands before. A window can only be repeated if the greatest extensions of
   its suffix cover it; most suffixes leave here. Suffixes whose whole surroundings equal those of an earlier one are
   repeated as they stand. At the ends of a piece that is worked on at once, extensions beyond it are assumed.
4. Extensions of different neighbours may add up, and codes may agree by chance, so the windows that remain are checked:
   those with an equal earlier one, by fingerprints of whole windows, are repeated.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased. Defined cases: null and empty texts have no
words; rows with a null id are passed over and stay whole; rows alike in id and text count as one document; other
columns are not read, and stay as they are in :func:`remove_repeats`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from ..shared import discard, materialize
from . import _text as T

MIN_WORDS, K, WINDOW = 50, 8, 43
PIECE = 1 << 16  # suffixes that are compared at once
SLICE = 1 << 21  # bytes of text that are worked on at once, with some ten times as much beside them
_PLACE = 28  # bits of a word's place within a batch
_SPANS = "array<struct<first:long,last:long>>"


def _anchors(h: np.ndarray, first: np.ndarray, min_words: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of ``min_words`` words within a row, and the minimiser that each relies on."""
    grams = T.windows(h, K)
    last = np.repeat(first[1:], np.diff(first))
    starts = np.flatnonzero(np.arange(len(h)) + min_words <= last)
    if not len(starts):
        return starts, starts
    v = (T.mix(grams) >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while width * 2 <= window:
        v = np.minimum(v[: len(v) - width], v[width:])
        width *= 2
    if width < window:
        v = np.minimum(v[: len(v) - (window - width)], v[window - width :])
    return starts, (v[starts] & np.uint64((1 << _PLACE) - 1)).astype(np.int64)


def _ragged_bytes(codes: np.ndarray, start: np.ndarray, length: np.ndarray, step: int = 1) -> pa.Array:
    """Binaries of the given lengths, read from ``start`` on, forwards or backwards."""
    row, at = T.ragged(length)
    offsets = np.zeros(len(length) + 1, np.int32)
    np.cumsum(length, out=offsets[1:])
    return pa.BinaryArray.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(codes[start[row] + step * at].tobytes())])


def _suffixes(texts: DataFrame, min_words: int, window: int, id_type: str) -> DataFrame:
    """``right, left, block, id, node, first, m, before``: the retained suffixes.

    Windows ``first`` to ``first + m - 1`` rely on the suffix, which stands ``before`` words after the first of them;
    ``block`` is the fingerprint of all their words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches, most=SLICE):
            _, _, h, first = T.words(*T.utf8(batch.column(2)), T.ALNUM)
            starts, anchor = _anchors(h, first, min_words, window)
            head = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)]) if len(starts) else np.zeros(0, bool)
            a = np.flatnonzero(head)
            count = np.diff(np.append(a, len(starts)))
            place, begin = anchor[a], starts[a]
            end = begin + count - 1 + min_words
            up, down = T._WORDS.upto(len(h) + 1)
            total = np.zeros(len(h) + 1, np.uint64)
            np.cumsum(h * up[: len(h)], out=total[1:])
            shape = (count.astype(np.uint64) << np.uint64(32)) + (place - begin).astype(np.uint64)
            block = T.mix(T.mix((total[end] - total[begin]) * down[begin]) + shape * np.uint64(0x9E3779B97F4A7C15))
            codes = (h >> np.uint64(56)).astype(np.uint8)
            row = np.searchsorted(first, begin, "right") - 1
            own = pa.array(row)
            columns = [_ragged_bytes(codes, place, end - place), _ragged_bytes(codes, place - 1, place - begin, -1), pa.array(T.signed(block)), batch.column(0).take(own), batch.column(1).take(own), pa.array(begin - first[row]), pa.array(count.astype(np.int32)), pa.array((place - begin).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["right", "left", "block", "id", "node", "first", "m", "before"])

    return texts.mapInArrow(run, f"right binary, left binary, block long, id {id_type}, node long, first long, m int, before int")


def _fixed(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Binaries as rows of ``width`` bytes, zeros after their ends, and their lengths."""
    length = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), width), np.uint8)
    row, at = T.ragged(length)
    out[row, at] = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
    return out, length


def _common(x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How far rows of x and y agree, ``most`` at most."""
    differ = np.concatenate([x != y, np.ones((len(x), 1), bool)], axis=1)
    return np.minimum(differ.argmax(axis=1), most)


def _next_to(x: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The longer agreement of each row with the one before and the one after it."""
    out = np.zeros(len(x), np.int64)
    if len(x) > 1:
        same = _common(x[1:], x[:-1], np.minimum(length[1:], length[:-1]))
        out[1:] = same
        np.maximum(out[:-1], same, out=out[:-1])
    return out


def _extend(table: pa.Table, min_words: int, window: int) -> pa.RecordBatch:
    """Compares a sorted piece: ``id, node, first, last`` of the windows that are repeated for ``sure`` or may be."""
    lead = min_words - window + 1
    right, length = _fixed(table.column("right").combine_chunks(), min_words)
    ends = right[[0, -1]], length[[0, -1]]
    # The first of each block: equal ones are in the order of document and place. Rows alike in both are one.
    _, kept, block = np.unique(table.column("block").to_numpy(), return_index=True, return_inverse=True)
    top = pa.array(kept[block])
    alike = [pc.equal(table.column(c), table.column(c).take(top)).to_numpy() for c in ("id", "node", "first")]
    later = ~np.logical_and.reduce(alike)
    kept = np.sort(kept)
    right, length = right[kept], length[kept]
    left, long = _fixed(table.column("left").combine_chunks().take(pa.array(kept)), window)
    far = _next_to(right, length)
    run = np.zeros(len(kept), np.int64)
    if len(kept) > 1:
        run[1:] = np.cumsum(_common(right[1:], right[:-1], np.minimum(length[1:], length[:-1])) < lead)
    keyed = np.concatenate([run.astype(">u4").view(np.uint8).reshape(-1, 4), left], axis=1)
    order = np.argsort(np.ascontiguousarray(keyed).view(f"S{keyed.shape[1]}").ravel(), kind="stable")
    back = np.zeros(len(kept), np.int64)
    back[order] = np.maximum(_next_to(keyed[order], long[order] + 4) - 4, -1)
    beyond = np.maximum(*(_common(right, np.broadcast_to(ends[0][i], right.shape), np.minimum(length, ends[1][i])) for i in (0, 1)))
    first, m, before = (table.column(c).to_numpy()[kept].astype(np.int64) for c in ("first", "m", "before"))
    # A window that the suffix stands o words into needs o words to the left and min_words - o to the right.
    least, most = before - m + 1, before
    low, high = np.maximum(min_words - far, least), np.minimum(back, most)
    none = low > high
    low, high = np.where(none, most + 1, low), np.where(none, least - 1, high)
    edge = np.maximum(min_words - beyond, least)
    reach = edge <= most
    low, high = np.where(reach, np.minimum(low, edge), low), np.where(reach, most, high)
    some = np.flatnonzero(low <= high)
    sure = np.flatnonzero(later)
    at = pa.array(np.concatenate([sure, kept[some]]))
    start, many = table.column("first").to_numpy()[sure], table.column("m").to_numpy()[sure]
    begin = np.concatenate([start, (first + before - high)[some]])
    end = np.concatenate([start + many - 1, (first + before - low)[some]])
    return pa.RecordBatch.from_arrays([table.column("id").take(at).combine_chunks(), table.column("node").take(at).combine_chunks(), pa.array(begin), pa.array(end), pa.array(np.arange(len(at)) < len(sure))], names=["id", "node", "first", "last", "sure"])


def _matches(suffixes: DataFrame, min_words: int, window: int, id_type: str) -> DataFrame:
    """The suffixes in order, and what comparing neighbours gives (see :func:`_extend`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            at = 0
            while at < len(batch):
                part = batch.slice(at, PIECE - n)
                held.append(part)
                n, at = n + len(part), at + len(part)
                if n == PIECE:
                    yield _extend(pa.Table.from_batches(held), min_words, window)
                    held, n = [], 0
        if n:
            yield _extend(pa.Table.from_batches(held), min_words, window)

    order = ["right", "id", "node", "first"]
    return suffixes.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, f"id {id_type}, node long, first long, last long, sure boolean")


def _windows(texts: DataFrame, asked: DataFrame, min_words: int, id_type: str) -> DataFrame:
    """``print, id, node, first``: the windows in the ranges asked for (``id, node, ranges``), from the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches, most=SLICE):
            _, _, h, first = T.words(*T.utf8(batch.column(2)), T.ALNUM)
            prints = T.windows(h, min_words)
            own, begin, end = [], [], []
            for i, ranges in enumerate(batch.column(3).to_pylist()):
                for x in _merge(ranges, min_words):
                    own.append(i)
                    begin.append(x["first"])
                    end.append(x["last"] + 1)
            own, begin, end = (np.array(x, np.int64) for x in (own, begin, end))
            row, step = T.ragged(end - begin)
            at = begin[row] + step
            doc = pa.array(own[row])
            yield pa.RecordBatch.from_arrays([pa.array(T.signed(prints[first[own[row]] + at])), batch.column(0).take(doc), batch.column(1).take(doc), pa.array(at)], names=["print", "id", "node", "first"])

    # By sorting at every size, like the other joins here: both sides grow with the corpus.
    return texts.join(asked.hint("merge"), ["id", "node"]).select("id", "node", "text", "ranges").mapInArrow(run, f"print long, id {id_type}, node long, first long").distinct()


def _merge(ranges: list, min_words: int) -> list[dict]:
    out: list[dict] = []
    for a, b in sorted((r["first"], r["last"]) for r in ranges):
        if out and a <= out[-1]["last"] + 1:
            out[-1]["last"] = max(out[-1]["last"], b)
        else:
            out.append({"first": a, "last": b})
    return out


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, node, spans``: for each document with repeated words, their merged spans in words from 0; node is its text's fingerprint."""
    if min_words < K + 2:
        raise ValueError(f"min_words must be {K + 2} or more")
    window = min(WINDOW, min_words - K - 1)
    text = F.col(f"`{text_col}`")
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("node"), text.alias("text")).filter("id is not null")
    id_type = texts.schema["id"].dataType.simpleString()
    matches = materialize(_matches(_suffixes(texts, min_words, window, id_type), min_words, window, id_type), "suffix-matches")
    asked = matches.filter("not sure").groupBy("id", "node").agg(F.collect_set(F.struct("first", "last")).alias("ranges"))
    asked = materialize(asked, "suffix-asked")  # its size is known to the join that follows
    windows = materialize(_windows(texts, asked, min_words, id_type), "suffix-windows")
    place = F.struct("id", "node", "first")
    tops = materialize(windows.groupBy("print").agg(F.min(place).alias("top"), F.count("*").alias("times")).filter("times > 1").select("print", "top"), "suffix-tops")
    more = windows.join(tops.hint("merge"), "print").filter(place != F.col("top")).select("id", "node", "first", (F.col("first") + min_words - 1).alias("last"))
    sure = matches.filter("sure").select("id", "node", "first", (F.col("last") + min_words - 1).alias("last"))
    ranges = sure.unionByName(more).groupBy("id", "node").agg(F.collect_set(F.struct("first", "last")).alias("ranges"))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([_merge(x, min_words) for x in batch.column(2).to_pylist()], kind)], names=["id", "node", "spans"])

    out = materialize(ranges.mapInArrow(merged, f"id {id_type}, node long, spans {_SPANS}"), "suffix-spans")
    discard(matches, asked, windows, tops)
    return out


def find_repeats(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: ``doc_id, n_words, n_repeated, spans`` (empty where nothing is repeated)."""
    text = F.col(f"`{text_col}`")
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("node"), text.alias("text"))
    id_type = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches):
            _, _, _, first = T.words(*T.utf8(batch.column(2)), T.ALNUM)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(first))], names=["id", "node", "n_words"])

    rows = texts.mapInArrow(run, f"id {id_type}, node long, n_words long")
    spans = F.coalesce("spans", F.array().cast(_SPANS))
    out = rows.join(repeated_spans(docs, min_words, id_col, text_col).hint("merge"), ["id", "node"], "left").select(F.col("id").alias("doc_id"), "n_words", spans.alias("spans"))
    return out.select("doc_id", "n_words", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1).alias("n_repeated"), "spans")


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", drop_emptied: bool = True) -> DataFrame:
    """The documents, all columns, without their repeated spans; ``n_chars`` is counted again where it exists.

    What stands between a span's first and last word goes with it. A document of which no word is left goes too,
    unless ``drop_emptied`` is false; documents that had no words stay.
    """
    spans = repeated_spans(docs, min_words, id_col, text_col).select(F.col("id").alias("__id"), F.col("node").alias("__node"), F.col("spans").alias("__spans"))
    place, schema = docs.columns.index(text_col), docs.schema
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches, text_col):
            columns = list(batch.columns[: len(schema)])
            lists = batch.column(len(schema)).to_pylist()
            data, offsets = T.utf8(columns[place])
            touched = [i for i, x in enumerate(lists) if x]
            if touched:
                s, e, _, first = T.words(data, offsets, T.ALNUM)
                texts, counts, keep = columns[place].to_pylist(), columns[chars].to_pylist() if chars is not None else None, np.ones(len(batch), bool)
                for i in touched:
                    raw, parts, at, left = texts[i].encode(), [], 0, int(first[i + 1] - first[i])
                    for span in lists[i]:
                        parts.append(raw[at : s[first[i] + span["first"]] - offsets[i]])
                        at = int(e[first[i] + span["last"]] - offsets[i])
                        left -= span["last"] - span["first"] + 1
                    texts[i] = (b"".join(parts) + raw[at:]).decode()
                    keep[i] = left > 0 or not drop_emptied
                    if counts is not None:
                        counts[i] = len(texts[i])
                columns[place] = pa.array(texts, columns[place].type)
                if counts is not None:
                    columns[chars] = pa.array(counts, columns[chars].type)
                yield pa.RecordBatch.from_arrays(columns, names=schema.names).filter(pa.array(keep))
            else:
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    same = F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col("__node"))
    joined = docs.join(spans.hint("merge"), same, "left").select(*[F.col(f"`{c}`") for c in docs.columns], "__spans")
    return joined.mapInArrow(cut, StructType(schema.fields))
