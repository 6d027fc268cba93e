"""Benchmark decontamination: broadcast hash set of normalised test n-grams, scanned over training windows.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased. A window is ``n`` consecutive
words of a benchmark item; an item of fewer words is one window, an item of none has none. Every window of
every document is looked up by fingerprint; what is found is verified word by word.

Defined cases: a null or empty text has no words and no hits; a null ``item_id`` marks words as hit but is not
named among the items; repeated items count once; repeated document rows each get their own result; empty
tables give no hits or no rows; other columns of the inputs are not read and may have any name.

A broadcast holds ``broadcast_windows`` windows or so at most. Where the benchmark has more, they are dealt by
fingerprint into as many sets, each is broadcast in turn and scanned for in the same way, and the hits of all scans are
joined to the documents by id and text, so that neither results nor the method depend on the benchmark's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..shared import materialize
from . import _text as T

N = 13
BROADCAST_WINDOWS = 500_000
_SPANS = "array<struct<first:bigint,last:bigint>>"
_HITS = f"n_words long, n_hit long, n_items long, items array<string>, spans {_SPANS}"
_NAMES = ["doc_id", "print", "n_words", "n_hit", "n_items", "items", "spans"]


def _lower(raw: bytes) -> bytes:
    return raw.lower()  # bytes.lower() touches A-Z only


def item_windows(benchmark: DataFrame, n: int = N, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item, k, print, words``: each window of each item, with its number of words and its normalised words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches):
            data, offsets = T.utf8(batch.column(1))
            s, e, h, first = T.words(data, offsets, T.ALNUM)
            raw = data.tobytes()
            rows = []
            for i, item in enumerate(batch.column(0).to_pylist()):
                m = int(first[i + 1] - first[i])
                k = min(n, m)
                for j in range(first[i], first[i + 1] - k + 1) if k else ():
                    text = b" ".join(_lower(raw[s[x] : e[x]]) for x in range(j, j + k)).decode()
                    rows.append((item, k, int(T.signed(T.windows(h[j : j + k], k))[0]), text))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.string(), pa.int32(), pa.int64(), pa.string()))], names=["item", "k", "print", "words"])

    return benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).mapInArrow(run, "item string, k int, print long, words string")


class _Index:
    """The broadcast windows: fingerprints by length, and for each the items that hold it."""

    def __init__(self, rows: list) -> None:
        self.by_k: dict[int, np.ndarray] = {}
        self.words: dict[tuple[int, int], dict[bytes, set]] = {}
        for item, k, p, text in rows:
            self.words.setdefault((k, p), {}).setdefault(text.encode(), set()).add(item)
        for k in {k for k, _ in self.words}:
            self.by_k[k] = np.sort(np.array([p for x, p in self.words if x == k], np.int64))
        self.light = {k: self._light(v) for k, v in self.by_k.items()}

    @staticmethod
    def _light(prints: np.ndarray) -> np.ndarray:
        out = np.zeros(1 << 20, bool)
        out[prints.view(np.uint64) >> np.uint64(44)] = True
        return out

    def found(self, k: int, h: np.ndarray) -> np.ndarray:
        """Places in ``h`` whose fingerprint some window of k words has."""
        at = np.flatnonzero(self.light[k][h >> np.uint64(44)])
        prints, got = self.by_k[k], h[at].view(np.int64)
        where = np.minimum(np.searchsorted(prints, got), len(prints) - 1)
        return at[prints[where] == got]


def _spans(mask: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return [{"first": int(a), "last": int(b) - 1} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _scan(batch_text: pa.Array, index: _Index) -> tuple[np.ndarray, np.ndarray, dict[int, tuple[np.ndarray, set]], tuple]:
    """Words of each row, hit words of each row, and for rows with hits their hit mask and items."""
    data, offsets = T.utf8(batch_text)
    s, e, h, first = T.words(data, offsets, T.ALNUM)
    raw, hits = None, {}
    for k in index.by_k:
        w = T.windows(h, k)
        for j in index.found(k, w).tolist():
            row = int(np.searchsorted(first, j, "right")) - 1
            if j + k > first[row + 1]:
                continue
            raw = data.tobytes() if raw is None else raw
            items = index.words[k, int(w[j : j + 1].view(np.int64)[0])].get(b" ".join(_lower(raw[s[x] : e[x]]) for x in range(j, j + k)))
            if items is None:
                continue
            mask, names = hits.setdefault(row, (np.zeros(int(first[row + 1] - first[row]), bool), set()))
            mask[j - first[row] : j - first[row] + k] = True
            names |= items
    n_hit = np.zeros(len(batch_text), np.int64)
    for row, (mask, _) in hits.items():
        n_hit[row] = mask.sum()
    return np.diff(first), n_hit, hits, (s, e, first, offsets)


def _result(batch: pa.RecordBatch, n_words: np.ndarray, n_hit: np.ndarray, hits: dict) -> list[pa.Array]:
    items = [sorted(x for x in hits[i][1] if x is not None) if i in hits else [] for i in range(len(batch))]
    spans = [_spans(hits[i][0]) if i in hits else [] for i in range(len(batch))]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))
    return [pa.array(x, t) for x, t in zip((n_words, n_hit, [len(x) for x in items], items, spans), kinds, strict=True)]


def _indexes(wins: DataFrame, most: int) -> tuple[int, Iterator[_Index]]:
    """How many sets of about ``most`` windows there are, and each of them when it is asked for."""
    sets = max(1, -(-wins.count() // most))
    share = F.pmod(F.xxhash64("print"), F.lit(sets))
    return sets, (_Index([tuple(r) for r in wins.filter(share == i).collect()]) for i in range(sets))


def _hits(texts: DataFrame, indexes: Iterator[_Index]) -> DataFrame:
    """``doc_id, print, n_words, n_hit, n_items, items, spans`` of each distinct id and text with hits in any set; texts: ``doc_id, text, print``."""
    spark = texts.sparkSession
    kind = texts.schema["doc_id"].dataType.simpleString()
    found = None
    for index in indexes:
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in T.slices(batches):
                n_words, n_hit, hits, _ = _scan(batch.column(1), shared.value)
                out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *_result(batch, n_words, n_hit, hits)], names=_NAMES)
                yield out.filter(pa.array(n_hit > 0))

        own = materialize(texts.mapInArrow(run, f"doc_id {kind}, print long, {_HITS}"), "decontaminate-hits")
        shared.unpersist()
        found = own if found is None else found.unionByName(own)
    lists = found.groupBy("doc_id", "print").agg(F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    # Spans of different sets may meet or overlap.
    none = F.array().cast(_SPANS)
    last = lambda a: F.element_at(a, -1)
    longer = lambda a, x: F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last(a)["first"].alias("first"), F.greatest(last(a)["last"], x["last"]).alias("last"))))
    spans = F.aggregate("spans", none, lambda a, x: F.when((F.size(a) > 0) & (F.get(a, F.size(a) - 1)["last"] + 1 >= x["first"]), longer(a, x)).otherwise(F.concat(a, F.array(x))))
    lists = lists.withColumn("spans", spans)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["last"] - x["first"] + 1)
    return lists.select("doc_id", "print", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans")


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Per document row: ``doc_id, n_words, n_hit, n_items, items`` (sorted as strings) and hit ``spans`` in words."""
    spark = docs.sparkSession
    wins = item_windows(benchmark, n, item_col, item_text_col)
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    sets, indexes = _indexes(wins, broadcast_windows)
    index = spark.sparkContext.broadcast(next(indexes) if sets == 1 else _Index([]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches):
            n_words, n_hit, hits, _ = _scan(batch.column(1), index.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *_result(batch, n_words, n_hit, hits), *batch.columns[2:]], names=[*(x for x in _NAMES if x != "print"), *batch.schema.names[2:]])

    if sets == 1:
        return texts.mapInArrow(run, f"doc_id {kind}, {_HITS}")
    texts = texts.withColumn("print", F.xxhash64("text"))
    words = texts.mapInArrow(run, f"doc_id {kind}, {_HITS}, print long").select("doc_id", "n_words", "print")
    d, h = words.alias("d"), _hits(texts, indexes).alias("h")
    joined = d.join(h, F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d.print") == F.col("h.print")), "left")
    none = {"n_hit": F.lit(0), "n_items": F.lit(0), "items": F.array().cast("array<string>"), "spans": F.array().cast(_SPANS)}
    return joined.select("d.doc_id", "d.n_words", *[F.coalesce(F.col(f"h.{c}"), x).alias(c) for c, x in none.items()])


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words", share: int = 20):
    """At least one hit word, and one in ``share`` of all words or more."""
    return (F.col(n_hit) > 0) & (F.lit(share) * F.col(n_hit) >= F.col(n_words))


def _cut(batch: pa.RecordBatch, found: dict[int, list], place: int, chars: int | None, s: np.ndarray, e: np.ndarray, first: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    """A batch without the spans ``found`` of its rows; s, e, first and offsets are those of its words."""
    texts, counts = batch.column(place).to_pylist(), batch.column(chars).to_pylist() if chars is not None else None
    for i, spans in found.items():
        raw, keep, at = texts[i].encode(), [], 0
        for span in spans:
            keep.append(raw[at : s[first[i] + span["first"]] - offsets[i]])
            at = e[first[i] + span["last"]] - offsets[i]
        texts[i] = (b"".join(keep) + raw[at:]).decode()
        if counts is not None:
            counts[i] = len(texts[i])
    columns = list(batch.columns)
    columns[place] = pa.array(texts, batch.schema.field(place).type)
    if counts is not None:
        columns[chars] = pa.array(counts, batch.schema.field(chars).type)
    return pa.RecordBatch.from_arrays(columns, schema=batch.schema)


def _decontaminate_by_sets(docs: DataFrame, indexes: Iterator[_Index], mode: str, share: int, text_col: str) -> DataFrame:
    own = F.col("doc_id") if "doc_id" in docs.columns else F.lit(None).cast("long")
    print_ = F.xxhash64(F.col(f"`{text_col}`"))
    hits = _hits(docs.select(own.alias("doc_id"), F.col(f"`{text_col}`").alias("text"), print_.alias("print")), indexes)
    found = hits.select(F.col("doc_id").alias("__id"), F.col("print").alias("__print"), "n_words", "n_hit", F.col("spans").alias("__spans"))
    same = own.eqNullSafe(F.col("__id")) & (print_ == F.col("__print"))
    if mode == "document":
        return docs.join(found.filter(contaminated(share=share)).select("__id", "__print"), same, "left_anti")
    place, width = docs.columns.index(text_col), len(docs.columns)
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches, text_col):
            spans = {i: x for i, x in enumerate(batch.column(width).to_pylist()) if x}
            batch = batch.select(range(width))
            if spans:
                data, offsets = T.utf8(batch.column(place))
                s, e, _, first = T.words(data, offsets, T.ALNUM)
                batch = _cut(batch, spans, place, chars, s, e, first, offsets)
            yield batch

    joined = docs.join(found.select("__id", "__print", "__spans"), same, "left").select(*[F.col(f"`{c}`") for c in docs.columns], "__spans")
    return joined.mapInArrow(run, docs.schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "document", share: int = 20, n: int = N, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """The documents, all columns as they were, without contaminated ones (``document``) or without hit words (``span``).

    In mode ``span`` what stands between the first and last hit word of each span goes, and an ``n_chars`` column
    is counted again. Where the windows need several broadcasts, rows are judged or cut by the hits of all scans,
    joined on ``doc_id`` (where there is one) and the text's fingerprint.
    """
    if mode not in ("document", "span"):
        raise ValueError(f"mode must be document or span, not {mode}")
    wins = item_windows(benchmark, n, item_col, item_text_col)
    sets, indexes = _indexes(wins, broadcast_windows)
    if sets > 1:
        return _decontaminate_by_sets(docs, indexes, mode, share, text_col)
    index = docs.sparkSession.sparkContext.broadcast(next(indexes))
    place = docs.columns.index(text_col)
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches, text_col):
            n_words, n_hit, hits, (s, e, first, offsets) = _scan(batch.column(place), index.value)
            if mode == "document":
                yield batch.filter(pa.array(~((n_hit > 0) & (share * n_hit >= n_words))))
                continue
            found = {i: _spans(mask) for i, (mask, _) in hits.items()}
            yield _cut(batch, found, place, chars, s, e, first, offsets)

    return docs.mapInArrow(run, docs.schema)
