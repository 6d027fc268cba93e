"""Exact n-gram Jaccard join by a token-group matrix.

A document's set holds its distinct ``k``-word shingles; two documents link when their Jaccard similarity is at
least ``num / den``. The join works on distinct sets (exact copies share one), in these steps:

1. one scan gives each document's set fingerprint and size, a few minhashes, and its shingles as a row of bits (four or
   more bits a shingle; a bit that one set has and another has not is a shingle that they do not share);
2. sets that share a minhash are compared with one leading set of that bucket (that of most copies); verified links
   join them to components early, so that a large group of copies costs one comparison per member;
3. *groups* of similar sets: each early component, cut to bounded size; every other set is a group of its own. The
   token-group matrix holds the union of each group's shingles, as bits;
4. shingles are ordered globally, those that many sets hold last (their counts are gathered in bounded summaries; any
   fixed order is exact). A set of n shingles can only link to a group that holds one of its first
   ``n - ceil(n num / den) + 1`` shingles among those of a member, so only such queries meet the group's row of the
   matrix, and only groups of another early component, whose sizes fit, also for what is left from that shingle on;
5. a query whose overlap with a group's union is bounded under ``n num / den`` cannot link to any member: the group
   stays shut to it;
6. qualifying queries open the group: their shingles meet those of its members, and overlaps are counted exactly.

Links are reported as long as they connect: one for each query and group. Their components are those of all links.
Minhashes, groups and the order of shingles bear on cost alone. Work grows with the square of a number of sets only
where that many are similar without being linked early.

A key that very many rows share is split: queries of a group are dealt by salts, members of a bucket too; rows of one
shingle that many sets have in common are joined by component, not by set, and skewed joins are left to AQE.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; with fewer than k words the whole sequence is one shingle.
Defined cases: null or empty texts, and texts without words, have an empty set and link with nothing; a null id
keeps its row, links with nothing and has its own null component; repeated ids keep a row each; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.graph import connected_components
from ..shared import discard, materialize
from . import _text as T
from ._bits import bit_set, in_bits

HASHES = 4
GROUP_SHINGLES, LEAST_WEIGHT = 300_000, 600  # a group's shingles, and what a small set counts for at least
HEAVY, HEAVY_A_TASK = 1 << 19, 1 << 17  # shingles that come last in the global order, and how many of them a task may name
QUERIES_A_SALT = 2000
SLICE = 1 << 22  # bytes of text that are worked on at once
_SEEDS = np.random.Generator(np.random.PCG64(11)).integers(0, 2**63, HASHES, dtype=np.uint64)
_SEED2 = np.uint64(0x5851F42D4C957F2D)


def _sets(batch: pa.RecordBatch, k: int, kind: np.ndarray = T.NONSPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All distinct shingles of a batch (id, text) end to end, their offsets, and each row's set fingerprint."""
    _, _, h, first = T.words(*T.utf8(batch.column(1)), kind)
    tokens, offsets = T.shingle_sets(h, first, k)
    total = np.zeros((2, len(tokens) + 1), np.uint64)
    np.cumsum(T.mix(tokens ^ _SEED2), out=total[0, 1:])
    node = T.mix(total[0, offsets[1:]] - total[0, offsets[:-1]] + np.diff(offsets).astype(np.uint64))
    return tokens, offsets, node


def _minima(tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """HASHES minhashes of each row that has tokens."""
    rows = np.flatnonzero(np.diff(offsets))
    out = np.zeros((len(offsets) - 1, HASHES), np.uint64)
    for j, seed in enumerate(_SEEDS):
        if len(rows):
            out[rows, j] = np.minimum.reduceat((tokens ^ seed) * np.uint64(0x9FB21C651E98DF25) ^ (tokens >> np.uint64(31)), offsets[rows])
    return out


def _bit_rows(tokens: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Each row's shingles as bits; their number is a power of two, four times that of the shingles or more."""
    size = np.diff(offsets)
    width = np.left_shift(1, np.maximum(np.ceil(np.log2(np.maximum(size, 1) * 4)), 6).astype(np.int64))
    row = np.repeat(np.arange(len(size)), size)
    begin = np.cumsum(width // 8) - width // 8
    bit = (tokens >> np.uint64(13)).astype(np.int64) & (width - 1)[row]
    flat = np.zeros(int((width // 8).sum()), np.uint8)
    np.bitwise_or.at(flat, begin[row] + (bit >> 3), np.left_shift(1, bit & 7).astype(np.uint8))
    raw = flat.tobytes()
    return [raw[a : a + w] for a, w in zip(begin.tolist(), (width // 8).tolist(), strict=True)]


def _fold(bits: np.ndarray, width: int) -> np.ndarray:
    """The same set's row at a smaller power of two."""
    return np.bitwise_or.reduce(bits.reshape(-1, width), axis=0)


def _most_common(x: np.ndarray, n: int, y: np.ndarray) -> int:
    """How many of the n shingles behind bits x those behind bits y can hold at most."""
    width = min(len(x), len(y))
    return n - int(np.bitwise_count(_fold(x, width) & ~_fold(y, width)).sum())


def _base(texts: DataFrame, k: int, id_type: str) -> DataFrame:
    """``id, print, n, node, minima, bits``: the text's fingerprint, and its set's size, fingerprint, minhashes and bits, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches, most=SLICE):
            tokens, offsets, node = _sets(batch, k)
            low = T.signed(_minima(tokens, offsets))
            minima = pa.ListArray.from_arrays(pa.array(np.arange(0, len(batch) * HASHES + 1, HASHES, dtype=np.int32)), pa.array(low.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.diff(offsets)), pa.array(T.signed(node)), minima, pa.array(_bit_rows(tokens, offsets), pa.binary())], names=["id", "print", "n", "node", "minima", "bits"])

    return texts.withColumn("print", F.xxhash64("text")).mapInArrow(run, f"id {id_type}, print long, n long, node long, minima array<long>, bits binary")


def _tokens_of(texts: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """``node, tokens`` (binary, ascending) of the wanted sets, one row each, by a scan that a bit set thins."""
    bits = texts.sparkSession.sparkContext.broadcast(bit_set(nodes, "node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()  # of this task; copies in other tasks go below
        for batch in T.slices(batches, most=SLICE):
            tokens, offsets, node = _sets(batch, k)
            size = np.diff(offsets)
            wanted = np.flatnonzero(in_bits(T.signed(node), bits.value) & (size > 0))
            rows = [i for i in wanted.tolist() if (x := int(node[i])) not in seen and (len(seen) > 1 << 20 or seen.add(x) is None)]
            yield pa.RecordBatch.from_arrays([pa.array(T.signed(node[rows])), pa.array([tokens[offsets[i] : offsets[i + 1]].tobytes() for i in rows], pa.binary())], names=["node", "tokens"])

    found = texts.mapInArrow(run, "node long, tokens binary").join(nodes.select("node").distinct(), "node", "left_semi")
    return found.groupBy("node").agg(F.first("tokens").alias("tokens"))


def _salt(node: str, salts) -> F.Column:
    return F.pmod(F.xxhash64(node), salts).cast("int")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those (a, b) whose sets reach the similarity; a leading set b is looked up once for each of its salts."""
    with_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta")), "a")
    leading = pairs.select("b", "salt").distinct().join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb")), "b")
    with_both = with_a.join(leading, ["b", "salt"]).select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if _similar(_common(x, y), len(x), len(y), num, den):
                    keep.append(i)
            keep = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], names=["a", "b"])

    return with_both.mapInArrow(run, "a long, b long")


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two ascending sets share."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def _similar(same, x, y, num: int, den: int):
    return den * same >= num * (x + y - same)


def _heavy(texts: DataFrame, k: int) -> np.ndarray:
    """Shingles that many sets hold, rarest first: at most HEAVY of them, from bounded summaries of all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in T.slices(batches):
            tokens, offsets, node = _sets(batch, k)
            _, once = np.unique(node, return_index=True)
            use = np.zeros(len(node), bool)
            use[once] = True
            fresh, times = np.unique(tokens[np.repeat(use, np.diff(offsets))], return_counts=True)
            fresh, times = fresh[times > 1], times[times > 1]
            token, inverse = np.unique(np.concatenate([token, fresh]), return_inverse=True)
            count = np.bincount(inverse, np.concatenate([count, times]), len(token)).astype(np.int64)
            if len(token) > HEAVY_A_TASK:
                top = np.sort(np.argpartition(-count, HEAVY_A_TASK)[:HEAVY_A_TASK])
                token, count = token[top], count[top]
        yield pa.RecordBatch.from_arrays([pa.array(T.signed(token)), pa.array(count)], names=["token", "times"])

    found = texts.mapInArrow(run, "token long, times long").groupBy("token").agg(F.sum("times").alias("times"))
    top = found.orderBy(F.desc("times"), "token").limit(HEAVY).toArrow().column(0).to_numpy()
    return np.ascontiguousarray(top[::-1]).view(np.uint64)


class _Order:
    """The global order of shingles: by value, but for heavy ones, which come last, rarest first."""

    def __init__(self, heavy: np.ndarray) -> None:
        self.rank = np.argsort(heavy, kind="stable")
        self.heavy = heavy[self.rank]

    def prefixes(self, tokens: np.ndarray, offsets: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, shingles, caps): each row's first ``n - ceil(n num / den) + 1`` in this order, as far as they can count.

        Where a shingle is the first that two sets share, both hold all that they share from there on. A set of n with r
        shingles from there on thus links to sets of ``r (num + den) / num - n`` shingles at most: the cap.
        """
        size = np.diff(offsets)
        row = np.repeat(np.arange(len(size)), size)
        wanted = np.where(size > 0, size + (-num * size // den) + 1, 0)
        if len(self.heavy) and len(tokens):
            at = np.minimum(np.searchsorted(self.heavy, tokens), len(self.heavy) - 1)
            last = self.heavy[at] == tokens
        else:
            at, last = np.zeros(len(tokens), np.int64), np.zeros(len(tokens), bool)
        light = np.zeros(len(tokens) + 1, np.int64)
        np.cumsum(~last, out=light[1:])
        place = light[:-1] - light[offsets[:-1]][row]
        first = ~last & (place < wanted[row])
        short = wanted - (light[offsets[1:]] - light[offsets[:-1]])
        rest = np.flatnonzero(last & (short[row] > 0))
        rest = rest[np.lexsort((self.rank[at[rest]], row[rest]))]
        _, begin, many = np.unique(row[rest], return_index=True, return_counts=True)
        rest = rest[(np.arange(len(rest)) - np.repeat(begin, many)) < short[row[rest]]]
        begin = np.flatnonzero(np.diff(row[rest], prepend=-1))
        behind = np.arange(len(rest)) - np.repeat(begin, np.diff(np.append(begin, len(rest))))
        ahead = np.flatnonzero(first)
        keep = np.concatenate([ahead, rest])
        at = np.concatenate([place[ahead], (light[offsets[1:]] - light[offsets[:-1]])[row[rest]] + behind])
        n = size[row[keep]]
        cap = (n - at) * (num + den) // num - n
        fits = cap * den >= n * num
        return row[keep][fits], tokens[keep][fits], cap[fits]


def _postings(texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """``token, node, cap``: the leading shingles of all sets, less those that one set alone leads with.

    Heavy shingles are known to have several sets, so they are not gathered by shingle at all.
    """
    heavy = _heavy(texts, k)
    order = texts.sparkSession.sparkContext.broadcast(_Order(heavy))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches, most=SLICE):
            tokens, offsets, node = _sets(batch, k)
            row, token, cap = order.value.prefixes(tokens, offsets, num, den)
            _, once = np.unique(node, return_index=True)
            use = np.isin(row, once)
            row, token, cap = row[use], token[use], cap[use]
            names = order.value.heavy
            at = np.minimum(np.searchsorted(names, token), max(len(names) - 1, 0))
            split = np.where(names[at] == token, node[row] % np.uint64(1 << 16), 0) if len(names) else np.zeros(len(token))
            yield pa.RecordBatch.from_arrays([pa.array(T.signed(token)), pa.array(split.astype(np.int32)), pa.array(T.signed(node[row])), pa.array(names[at] == token if len(names) else np.zeros(len(token), bool)), pa.array(cap)], names=["token", "split", "node", "heavy", "cap"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row before: its shingle, its set, and whether it has been passed on
        for batch in batches:
            if not len(batch):
                continue
            token, node = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            heavy, cap = batch.column(3).to_numpy(zero_copy_only=False), batch.column(4).to_numpy()
            if last is not None:
                token, node, heavy, cap = (np.append(x, y) for x, y in zip((last[0], last[1], *last[3:]), (token, node, heavy, cap), strict=True))
            again = np.zeros(len(token), bool)
            again[1:] = (token[1:] == token[:-1]) & (node[1:] == node[:-1])
            run = np.zeros(len(token), bool)
            run[1:] = token[1:] == token[:-1]
            several = np.zeros(len(token), bool)  # another set with this shingle stands beside it
            several[1:] |= run[1:] & ~again[1:]
            several[:-1] |= run[1:] & ~again[1:]
            start = np.flatnonzero(~run)
            several = np.logical_or.reduceat(several, start)[np.cumsum(~run) - 1] | heavy
            done = last is not None and last[2]
            if done:  # its run has several sets
                several[: start[1] if len(start) > 1 else len(several)] = True
            out = several & ~again
            if done:
                out[0] = False
            # The last row waits for the next batch unless its run is known to have several sets.
            last = (token[-1:], node[-1:], bool(several[-1]), heavy[-1:], cap[-1:])
            if not last[2]:
                out[-1] = False
            yield pa.RecordBatch.from_arrays([pa.array(token[out]), pa.array(node[out]), pa.array(cap[out])], names=["token", "node", "cap"])

    dealt = texts.mapInArrow(deal, "token long, split int, node long, heavy boolean, cap long")
    return dealt.repartition("token", "split").sortWithinPartitions("token", "node").mapInArrow(shared, "token long, node long, cap long")


def _grouped(sets: DataFrame, early: DataFrame) -> DataFrame:
    """``node, n, family, grp, size``: early components cut to groups by running weight, all other sets groups of one; size is the component's.

    The order is dealt by ranges, so a component of any size runs over many tasks; a window over a whole component
    sees one row per range.
    """
    members = early.select("node", F.col("component").alias("family")).join(sets.select("node", "n"), "node")
    sizes = early.groupBy(F.col("component").alias("family")).agg(F.count("*").alias("size"))
    order = ["family", "n", "node"]
    ranged = members.withColumn("weight", F.greatest("n", F.lit(LEAST_WEIGHT))).repartitionByRange(*order)
    ranged = materialize(ranged.withColumn("range", F.spark_partition_id()), "near-ranges")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("family", "range").agg(F.sum("weight").alias("sum"))
    sums = sums.select("family", "range", F.coalesce(F.sum("sum").over(before.partitionBy("family").orderBy("range")), F.lit(0)).alias("start"))
    running = F.coalesce(F.sum("weight").over(before.partitionBy("family", "range").orderBy("n", "node")), F.lit(0))
    cut = ranged.withColumn("running", running).join(sums, ["family", "range"])
    cut = cut.select("node", "n", "family", F.floor((F.col("start") + F.col("running")) / GROUP_SHINGLES).alias("grp"))
    cut = materialize(cut, "near-cut").join(materialize(sizes, "near-sizes"), "family").select("node", "n", "family", "grp", "size")
    single = sets.join(early.select("node"), "node", "left_anti").select("node", "n", F.col("node").alias("family"), F.lit(0).cast("long").alias("grp"), F.lit(1).cast("long").alias("size"))
    out = materialize(cut.unionByName(single), "near-groups")
    discard(ranged)
    return out


def _candidates(postings: DataFrame, groups: DataFrame, num: int, den: int) -> DataFrame:
    """``q, n, family, grp``: queries and groups of other components that lead with a common shingle and fit in size.

    Components that meet in a shingle are paired first, the smaller one asking, so that a component's own members never
    meet each other.
    """
    # All sides of these joins grow with the corpus, so they are sorted at every size.
    every = materialize(postings.join(groups.hint("merge"), "node"), "near-held")
    met = every.groupBy("token").agg(F.min("family").alias("x"), F.max("family").alias("y")).filter("x < y").select("token")
    held = materialize(every.join(met.hint("merge"), "token", "left_semi"), "near-met")
    # What each group's row of the matrix leads with, and the sizes of the members that do.
    rows = held.groupBy("token", "family", "size", "grp").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("cap").alias("most"))
    of = rows.groupBy("token", "family", "size").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("most").alias("most"))
    ask, give = (of.select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("family", "size", "low", "high", "most")]) for s in ("q", "g"))
    fit = lambda a, b, c, d: (F.col(b) * den >= F.col(c) * num) & (F.col(d) * den >= F.col(a) * num)
    pairs = ask.join(give.hint("merge"), "token").filter(F.struct("size_q", "family_q") < F.struct("size_g", "family_g")).filter(fit("low_q", "high_q", "low_g", "high_g")).filter("low_q <= most_g and low_g <= most_q").select("token", "family_q", "family_g")
    asked = held.select("token", F.col("family").alias("family_q"), F.col("node").alias("q"), F.col("n").alias("nq"), "cap").join(pairs.hint("merge"), ["token", "family_q"])
    given = rows.select("token", F.col("family").alias("family_g"), "grp", "low", "high", "most")
    out = asked.join(given.hint("merge"), ["token", "family_g"]).filter(fit("nq", "nq", "low", "high")).filter("nq <= most and low <= cap")
    out = materialize(out.select("q", F.col("family_g").alias("family"), "grp").distinct(), "near-candidates")
    discard(every, held)
    return out


def _dealt(asked: DataFrame, rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows of groups (``family, grp, node, tokens``) followed by the queries that meet each, dealt by salts and sorted."""
    key = ["family", "grp"]
    salts = asked.groupBy(*key).agg(F.ceil(F.count("*") / QUERIES_A_SALT).cast("int").alias("salts"))
    head = rows.join(salts, key).select(*key, F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("side"), "node", "tokens")
    tail = asked.join(salts, key).join(sets.select(F.col("node").alias("q"), "tokens"), "q").select(*key, _salt("q", F.col("salts")).alias("salt"), F.lit(1).alias("side"), F.col("q").alias("node"), "tokens")
    return head.unionByName(tail).repartition(*key, "salt").sortWithinPartitions(*key, "salt", "side")


def _bits_of(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, n, bits`` of the sets named; few of all, so that joins need not move the others."""
    return sets.select("node", "n", "bits").join(nodes.distinct(), "node", "left_semi")


def _bounded(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """The rows of ``pairs`` whose bits allow a link: those of a query (``n, bits``) against a set or group (``m, of``).

    ``m`` is the size of a set, or null for a group of several.
    """
    places = [pairs.columns.index(c) for c in ("n", "bits", "m", "of")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (n, x, m, y) in enumerate(zip(*(batch.column(c) for c in places), strict=True)):
                n, m, x, y = n.as_py(), m.as_py(), np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
                same = _most_common(x, n, y)
                if den * same >= num * n and (m is None or _similar(min(same, _most_common(y, m, x)), n, m, num, den)):
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int32()))

    return pairs.mapInArrow(run, pairs.schema).drop("n", "bits", "m", "of")


def _opened(num: int, den: int):
    """Streams a group's members, then its qualifying queries: gives one link for each query that has some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, sets, index = [], [], None
        for batch in batches:
            a, b = [], []
            for side, own, tokens in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5), strict=True):
                x = np.frombuffer(tokens.as_buffer(), np.uint64)
                if side == 0:
                    if index is not None:
                        nodes, sets, index = [], [], None
                    nodes.append(own)
                    sets.append(x.copy())
                    continue
                if index is None:
                    every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
                    order = np.argsort(every, kind="stable")
                    index, sizes = (every[order], owner[order]), np.array([len(s) for s in sets])
                begin, end = np.searchsorted(index[0], x, "left"), np.searchsorted(index[0], x, "right")
                row, step = T.ragged(end - begin)
                same = np.bincount(index[1][begin[row] + step], minlength=len(sets))
                linked = np.flatnonzero(_similar(same, len(x), sizes, num, den))
                if len(linked):
                    a.append(own)
                    b.append(nodes[linked[0]])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def links(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, links): ``id, print, n, node`` for every row, and links ``a, b`` between distinct sets (nodes)."""
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = materialize(_base(texts, k, texts.schema["id"].dataType.simpleString()), "near-base")
    live = texts.filter("id is not null")
    sets = rows.filter("n > 0 and id is not null").groupBy("node").agg(F.first("n").alias("n"), F.count("*").alias("copies"), F.first("minima").alias("minima"), F.first("bits").alias("bits"))
    sets = materialize(sets, "near-sets")

    # Early components: sets that share a minhash, verified against that bucket's leading set.
    buckets = sets.select("node", "n", "copies", F.posexplode("minima").alias("j", "m"))
    tops = buckets.groupBy("j", "m").agg(F.max(F.struct("copies", "node", "n")).alias("top"), F.count("*").alias("size")).filter("size > 1")
    stars = buckets.join(tops.select("j", "m", F.col("top.node").alias("b"), F.col("top.n").alias("nb"), F.ceil(F.col("size") / QUERIES_A_SALT).alias("salts")), ["j", "m"]).filter("node <> b")
    stars = stars.filter(F.col("n") * den >= F.col("nb") * num).filter(F.col("nb") * den >= F.col("n") * num)
    stars = stars.groupBy(F.col("node").alias("a"), "b").agg(F.max(_salt("node", F.col("salts"))).alias("salt"))
    pairs = materialize(stars, "near-pairs")
    own = _bits_of(sets, pairs.select(F.col("a").alias("node"))).withColumnRenamed("node", "a")
    other = _bits_of(sets, pairs.select(F.col("b").alias("node"))).select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("bits").alias("of"))
    stars = materialize(_bounded(pairs.join(own, "a").join(other, "b"), num, den), "near-stars")
    wanted = stars.select(F.col("a").alias("node")).unionByName(stars.select(F.col("b").alias("node"))).distinct()
    near = materialize(_verified(stars, _tokens_of(live, wanted, k), num, den), "near-verified")
    early = connected_components(near)

    # Queries and the groups that they may link to, by leading shingles.
    groups = _grouped(sets, early)
    asked = _candidates(_postings(live, k, num, den), groups, num, den)

    # The matrix: the union of each group's shingles.
    given = groups.join(asked.select("family", "grp").distinct(), ["family", "grp"], "left_semi").select("node", "family", "grp")
    given = given.join(_bits_of(sets, given.select("node")), "node")

    def union(table: pa.Table) -> pa.Table:
        rows = [np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("bits")]
        width = min(len(x) for x in rows)
        every = np.bitwise_or.reduce([_fold(x, width) for x in rows])
        size = table.column("n")[0].as_py() if len(rows) == 1 else None
        return pa.table({"family": table.column("family")[:1], "grp": table.column("grp")[:1], "m": pa.array([size], pa.int64()), "of": pa.array([every.tobytes()], pa.binary())})

    several = given.filter("node <> family or grp <> 0").select("family", "grp").distinct()
    single = given.join(several, ["family", "grp"], "left_anti").select("family", "grp", F.col("n").alias("m"), F.col("bits").alias("of"))
    unions = given.join(several, ["family", "grp"], "left_semi").select("family", "grp", "n", "bits").groupBy("family", "grp").applyInArrow(union, "family long, grp long, m long, of binary")
    matrix = materialize(single.unionByName(unions), "near-matrix")

    # Bound each query's overlap with the groups' unions, then open the groups that qualify.
    queries = _bits_of(sets, asked.select(F.col("q").alias("node"))).withColumnRenamed("node", "q")
    bounded = materialize(_bounded(asked.join(queries, "q").join(matrix, ["family", "grp"]), num, den).select("q", "family", "grp"), "near-bounded")
    members = groups.join(bounded.select("family", "grp").distinct(), ["family", "grp"], "left_semi").select("family", "grp", "node")
    wanted = members.select("node").unionByName(bounded.select(F.col("q").alias("node"))).distinct()
    tokens = materialize(_tokens_of(live, wanted, k), "near-tokens")
    found = _dealt(bounded, members.join(tokens, "node"), tokens).mapInArrow(_opened(num, den), "a long, b long")
    documents = rows.select("id", "print", "n", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("node")).alias("node"))
    out = materialize(near.unionByName(found), "near-links")
    discard(sets, pairs, stars, near, groups, asked, matrix, bounded, tokens)
    return documents, out


def near_duplicate_components(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` per document row: the least id reachable by links, itself included."""
    documents, found = links(docs, k, num, den, id_col, text_col)
    return _with_components(documents, found).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))


def _with_components(documents: DataFrame, found: DataFrame) -> DataFrame:
    """Adds ``part``, the component of a row's set, and ``least``, the least id in it."""
    documents = documents.join(connected_components(found), "node", "left").withColumn("part", F.coalesce("component", "node"))
    least = documents.filter("part is not null").groupBy("part").agg(F.min("id").alias("least"))
    return documents.join(least, "part", "left")


def one_of_each(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, one of each component: that of the least id (and of least text fingerprint under it).

    Rows are told apart by id and text. Of rows alike in both one stays; rows with a null id, and all documents without
    words, stay.
    """
    documents, found = links(docs, k, num, den, id_col, text_col)
    parts = _with_components(documents, found).filter("part is not null")
    first = parts.groupBy("part").agg(F.min(F.struct("id", "print")).alias("kept"))
    gone = parts.join(first, "part").filter(F.struct("id", "print") != F.col("kept")).select(F.col("id").alias(id_col), F.col("print").alias("__print")).distinct()
    gone = materialize(gone, "near-gone")
    # Rows are dealt by id and text once, at every size, which also brings rows alike in both together.
    dealt = docs.withColumn("__print", F.xxhash64(F.col(f"`{text_col}`"))).join(gone.hint("merge"), [id_col, "__print"], "left_anti")
    alike = F.row_number().over(Window.partitionBy(id_col, "__print").orderBy(F.lit(1)))
    return dealt.withColumn("__alike", alike).filter(F.col(f"`{id_col}`").isNull() | (F.col("__alike") == 1)).select(docs.columns)
