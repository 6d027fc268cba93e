"""Log10 probability of texts under n-gram counts that are held, quantised, in a Bloom filter.

Training: words of all training texts and their n-grams are counted by Spark (tasks add up before the shuffle). A count n
is quantised to the level 1 + floor(log2 n), and the n-gram goes into the filter once for each level up to its own. The
filter is dealt by slots of the n-grams' hashes: a slot has as many pages of 4 KB as one byte for each entry needs, all
entries of an n-gram lie on one page, and a task that counts a slot's n-grams sets its pages' bits. Nothing is left out:
the filter grows with the n-grams. It is broadcast in parts of ``part_mb`` at most; where there are several, documents
are scanned once for each, and what the scans find is put together by row.

Scoring: levels 1, 2, ... of an n-gram are probed until one is missing; no level may exceed those of the n-gram's first
and last word, which takes false positives away. A level stands for the mean of its range. Probabilities back off by
Dirichlet smoothing, p(w|h) = (c(hw) + mu p(w|h')) / (c(h) + mu), down to add-one unigrams over V + 1 words.

``base_score`` is exact: of all words' counts the ``most_words`` highest at most are broadcast, others meet their rows
in a join, as words and not as fingerprints.

Defined cases: null and empty texts are one token, the end; a null id counts as training; without training texts N and V
are 0 and both scores 0; repeated rows each train and get a row; extra columns are not read; an empty table gives no rows.
Memory follows the slice (1 MB of text or one longer text), ``part_mb`` and ``most_words``.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import _counts, _text as T

ORDER = 2
MU = 64.0
MOST_WORDS = 1 << 18
PART_MB = 96
LOG_SLOTS = 12
_PAGE = 1 << 15  # bits
_PROBES = 4
_U = np.uint64
_BEGIN, _END = _U(0x243F6A8885A308D3), _U(0x13198A2E03707344)
_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
END = b" "  # the end's key among words, which hold no blank


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text, mod 7, is 2."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 7 == 2, F.lit(False))


def words(raw: bytes, most: int = 1 << 22) -> Iterator[list[bytes]]:
    """Words of a text, A-Z in lower case, in lists of about ``most`` bytes of text."""
    at = 0
    while at < len(raw):
        gap = _SPACE.search(raw, at + most) if at + most < len(raw) else None
        to = gap.start() if gap else len(raw)
        yield raw[at:to].translate(_FOLD).split()
        at = to


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes]:
    data, offsets = T.utf8(batch.column(column))
    raw, at = data.tobytes(), offsets.tolist()
    return [raw[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]


def grams(batch: pa.RecordBatch, column: int, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Keys of all 1- to ``order``-grams of each text between a begin and an end, by their last token; and where texts begin.

    At places where an n-gram would reach into the text before, its key stands for nothing.
    """
    _, _, prints, first = T.words(*T.utf8(batch.column(column)), T.NONSPACE)
    rows = len(first) - 1
    per = np.diff(first) + 2
    begins = np.concatenate([[0], np.cumsum(per)])
    line = np.empty(int(begins[-1]), _U)
    inner = np.ones(len(line), bool)
    if rows:
        line[begins[:-1]], line[begins[1:] - 1] = _BEGIN, _END
        inner[begins[:-1]] = inner[begins[1:] - 1] = False
    line[inner] = prints
    out = [T.mix(line ^ _U(0x452821E638D01377))]
    for k in range(2, order + 1):
        out.append(np.concatenate([np.zeros(min(k - 1, len(line)), _U), T.windows(line, k) ^ _U(k)]))
    return out, begins


def _has(begins: np.ndarray, k: int) -> np.ndarray:
    """Which places of the texts end a k-gram."""
    _, place = T.ragged(np.diff(begins))
    return place >= k - 1


def _slot(keys: np.ndarray, log_slots: int) -> np.ndarray:
    return (keys >> _U(64 - log_slots)).astype(np.int64)


@dataclass
class Filter:
    """The pages of some slots, and those of all n-grams that lie elsewhere have level 0."""

    bits: np.ndarray
    first_slot: int
    pages: int  # of each slot
    log_slots: int

    def level(self, keys: np.ndarray, most: np.ndarray | None = None) -> np.ndarray:
        """How many of the levels 1, 2, ... of each key are in the filter, up to the first that is missing (or ``most``)."""
        slot = _slot(keys, self.log_slots) - self.first_slot
        out = np.zeros(len(keys), np.uint8)
        live = (slot >= 0) & (slot * self.pages * _PAGE < 8 * len(self.bits))
        if most is not None:
            live &= most > 0
        live, at = np.flatnonzero(live), 1
        page = slot * self.pages + _page(keys, self.pages, self.log_slots)
        while len(live):
            met = np.ones(len(live), bool)
            for bit in _bits(keys[live], at):
                where = page[live] * _PAGE + bit
                met &= (self.bits[where >> 3] >> (where & 7).astype(np.uint8)) & np.uint8(1) > 0
            live = live[met]
            out[live] = at
            if most is not None:
                live = live[most[live] > at]
            at += 1
            if at > 64:
                break
        return out


def _page(keys: np.ndarray, pages: int, log_slots: int) -> np.ndarray:
    """Pages of a slot follow the order of the keys."""
    return (((keys << _U(log_slots)) >> _U(32)) * _U(pages) >> _U(32)).astype(np.int64)


def _bits(hashes: np.ndarray, level: int) -> list[np.ndarray]:
    """Places on the page of a level's entries."""
    g = T.mix(hashes + _U(level * 0x9E3779B97F4A7C15 % 2**64))
    return [((g >> _U(15 * i)) & _U(_PAGE - 1)).astype(np.int64) for i in range(_PROBES)]


@dataclass
class Model:
    """What scoring needs: word counts, n-gram counts, N, V, and pages of a slot."""

    words: DataFrame
    grams: DataFrame
    tokens: int
    distinct: int
    pages: int
    order: int
    log_slots: int

    def parts(self, part_mb: int) -> Iterator[Filter]:
        """The filter, in parts of whole slots; each goes through the driver, ``part_mb`` at most (or one slot)."""
        pages, log_slots = self.pages, self.log_slots
        slots = max(1, min(1 << log_slots, (part_mb << 23) // (pages * _PAGE)))
        for first in range(0, 1 << log_slots, slots):
            count = min(slots, (1 << log_slots) - first)

            def run(batches: Iterator[pa.RecordBatch], first: int = first, count: int = count) -> Iterator[pa.RecordBatch]:
                made: dict[int, np.ndarray] = {}
                for batch in batches:
                    h = batch.column(0).to_numpy().view(_U)
                    slot = _slot(h, log_slots) - first
                    inside = (slot >= 0) & (slot < count)
                    h, slot, n = h[inside], slot[inside], batch.column(1).to_numpy()[inside]
                    levels = np.frexp(n.astype(np.float64))[1]  # 1 + floor(log2 n)
                    page, at = slot * pages + _page(h, pages, log_slots), 1
                    while len(h):
                        where = np.concatenate([page * _PAGE + bit for bit in _bits(h, at)])
                        where.sort()
                        own, begin = np.unique(where >> 15, return_index=True)
                        for p, part in zip(own.tolist(), np.split(where & (_PAGE - 1), begin[1:]), strict=True):
                            held = made.setdefault(p, np.zeros(_PAGE, bool))
                            held[part] = True
                        keep = levels > at
                        h, page, levels, at = h[keep], page[keep], levels[keep], at + 1
                    if len(made) > 2048:
                        yield _pages(made)
                        made = {}
                yield _pages(made)

            def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                held: dict[int, np.ndarray] = {}
                for batch in batches:
                    for p, bits in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                        new = np.frombuffer(bits.as_buffer(), np.uint8)
                        held[p] = held[p] | new if p in held else new
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["page", "bits"])

            pages_of = self.grams.mapInArrow(run, "page int, bits binary").repartition("page").mapInArrow(join, "page int, bits binary")
            bits = np.zeros(count * pages * _PAGE // 8, np.uint8)
            for batch in pages_of.toArrow().to_batches():
                for p, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    bits[p * _PAGE // 8 : (p + 1) * _PAGE // 8] = np.frombuffer(x.as_buffer(), np.uint8)
            yield Filter(bits, first, pages, log_slots)


def _pages(made: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(made), pa.int32()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in made.values()], pa.binary())], names=["page", "bits"])


def fit(docs: DataFrame, text_col: str = "text", order: int = ORDER, log_slots: int = LOG_SLOTS) -> Model:
    """Counts of all words and n-grams of all rows of ``docs``."""
    texts = docs.select(F.col(f"`{text_col}`").alias("text"))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in T.slices(batches, most=1 << 20):
            for text in _texts(batch, 0):
                for some in words(text):
                    held.update(some)
            held[END] += len(batch)
            if len(held) > 1 << 19:
                yield out()
                held.clear()
        yield out()

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def keys() -> Iterator[np.ndarray]:
            for batch in T.slices(batches, most=1 << 20):
                by_order, begins = grams(batch, 0, order)
                for k, x in enumerate(by_order, 1):
                    yield T.signed(x[_has(begins, k)])

        for own, n in _counts.added(keys(), 1 << 22):
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n), pa.array(_slot(own.view(_U), log_slots).astype(np.int32))], names=["gram", "n", "slot"])

    all_words = _counts.stored(texts.mapInArrow(count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm-words")
    dealt = texts.mapInArrow(count_grams, "gram long, n long, slot int").repartition("slot")
    all_grams = _counts.stored(dealt.groupBy("slot", "gram").agg(F.sum("n").alias("n")).select("gram", "n").sortWithinPartitions("gram"), "lm-grams")
    tokens, distinct = all_words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    entries = all_grams.agg(F.coalesce(F.sum(F.floor(F.log2("n")) + 1), F.lit(0))).first()[0]
    return Model(all_words, all_grams, tokens, distinct, max(1, -(-8 * entries // (_PAGE << log_slots))), order, log_slots)


def probabilities(levels: list[np.ndarray], begins: np.ndarray, tokens: int, distinct: int, mu: float) -> np.ndarray:
    """Log10 probability of each text from the levels of its n-grams."""
    means = np.concatenate([[0.0], (3 * 2.0 ** np.arange(64) - 1) / 2])  # of 2**(q-1) to 2**q - 1
    one = levels[0]
    c = means[one]
    p = (c + 1) / (tokens + distinct + 1)
    history = np.concatenate([[0.0], c[:-1]])  # of the n-gram without its last token
    for k in range(2, len(levels) + 1):
        has = _has(begins, k)
        first = np.concatenate([np.zeros(k - 1, np.uint8), one[: len(one) - k + 1]])
        now = means[np.minimum(np.minimum(levels[k - 1], one), first)] * has
        now = np.minimum(now, history)
        p = np.where(has, (now + mu * p) / (history + mu), p)
        history = np.concatenate([[0.0], now[:-1]])
    p[begins[:-1]] = 1  # the begin is no token
    row = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    return np.bincount(row, weights=np.log10(p), minlength=len(begins) - 1)


def _levels(batch: pa.RecordBatch, column: int, order: int, held: Filter) -> tuple[list[np.ndarray], np.ndarray]:
    keys, begins = grams(batch, column, order)
    out = []
    for x in keys:
        own, turn = np.unique(x, return_inverse=True)
        out.append(held.level(own)[turn])
    return out, begins


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", mu: float = MU, most_words: int = MOST_WORDS, part_mb: int = PART_MB) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row."""
    context, order, tokens, distinct = docs.sparkSession.sparkContext, model.order, model.tokens, model.distinct
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), held_out(id_col).alias("held_out"))
    sent, rest = _counts.split(model.words, "n", most_words)
    table = sent.select("word", "n").toArrow()
    known = context.broadcast(dict(zip(table.column("word").to_pylist(), np.log10(table.column("n").to_numpy() + 1.0).tolist(), strict=True)))
    del table
    parts = iter(model.parts(part_mb))
    first = context.broadcast(next(parts))
    alone = len(first.value.bits) * 8 == (model.pages * _PAGE) << model.log_slots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_of, held = known.value.get, first.value
        for batch in T.slices(batches, most=1 << 20):
            levels, begins = _levels(batch, 1, order, held)
            met, total, words_, often, size = [], [], [], [], [0]
            for text in _texts(batch, 1):
                found = Counter([END])
                for some in words(text):
                    found.update(some)
                hits, sum_of, missed = 0, 0.0, 0
                for w, times in found.items():
                    if log := log_of(w):
                        hits += times
                        sum_of += times * log
                    else:
                        words_.append(w)
                        often.append(times)
                        missed += 1
                met.append(hits)
                total.append(sum_of)
                size.append(size[-1] + missed)
            packed = [None] * len(batch) if alone else _pack(levels, begins)
            scores = probabilities(levels, begins, tokens, distinct, mu)
            lists = [pa.ListArray.from_arrays(pa.array(size, pa.int32()), x) for x in (pa.array(words_, pa.binary()), pa.array(often, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.diff(begins) - 1), pa.array(met, pa.int64()), pa.array(total, pa.float64()), pa.array(scores), *lists, pa.array(packed, pa.binary()), batch.column(3)], names=["doc_id", "held_out", "n_tokens", "met", "total", "score", "words", "often", "levels", "row"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    columns = f"doc_id {kind}, held_out boolean, n_tokens long, met long, total double, score double, words array<binary>, often array<long>, levels binary, row long"
    if alone:
        numbered = texts.withColumn("row", F.monotonically_increasing_id())
    else:
        numbered = _counts.stored(texts.withColumn("row", F.monotonically_increasing_id()), "lm-texts")
    scored = _counts.stored(numbered.mapInArrow(run, columns), "lm-scored")
    if not alone:
        scored = _whole(scored, numbered, parts, order, tokens, distinct, mu)
    missed = scored.select("row", F.explode(F.arrays_zip("words", "often")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.often").alias("times"))
    more = missed.join(rest, "word").groupBy("row").agg(F.sum("times").alias("more_met"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"))
    added = lambda x, y: F.col(x) + F.coalesce(F.col(y), F.lit(0))
    base = added("total", "more") - F.col("n_tokens") * F.log10(F.lit(float(tokens + distinct + 1)))
    return scored.join(more, "row", "left").select("doc_id", "held_out", "n_tokens", added("met", "more_met").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def _pack(levels: list[np.ndarray], begins: np.ndarray) -> list[bytes]:
    """Each text's levels of all orders, end to end, compressed."""
    return [zlib.compress(b"".join([x[a:b].tobytes() for x in levels]), 1) for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]


def _whole(scored: DataFrame, texts: DataFrame, parts: Iterator[Filter], order: int, tokens: int, distinct: int, mu: float) -> DataFrame:
    """Scores from the levels that all parts of the filter hold: a scan for each part, and their levels added by row."""
    context, scans = texts.sparkSession.sparkContext, [scored.select("row", "levels")]
    for part in parts:
        shared = context.broadcast(part)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in T.slices(batches, most=1 << 20):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_pack(*_levels(batch, 1, order, shared.value)), pa.binary())], names=["row", "levels"])

        scans.append(_counts.stored(texts.select("row", "text").mapInArrow(scan, "row long, levels binary"), "lm-levels"))
    together = reduce(DataFrame.unionByName, scans).groupBy("row").agg(F.collect_list("levels").alias("levels"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for some in batch.column(1).to_pylist():
                flat = sum(np.frombuffer(zlib.decompress(x), np.uint8) for x in some)
                levels = list(flat.astype(np.uint8).reshape(order, -1))
                out.append(probabilities(levels, np.array([0, len(levels[0])]), tokens, distinct, mu)[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["row", "score"])

    return scored.drop("score", "levels").join(together.mapInArrow(put, "row long, score double"), "row")
