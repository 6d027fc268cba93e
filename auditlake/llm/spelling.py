"""Groups of spelling variants: words one inserted, deleted or replaced letter apart, each led to its most frequent form.

Words are dealt along a trie of letter-group counts. Letters are put into groups by their frequency over all words; a
word's path is its length and then its count in each group. The first ``depth`` steps of the path name a cell, which is
one task's work; ``depth`` is the least at which no cell holds more than ``block`` words, and cells that do so at full
depth are cut into blocks. One letter more, or one replaced, changes the path by one surplus and at most one deficit, so
a word is sent as a query to its own cell and to those that this budget reaches, each with what is left of it; of two
words one is the query (the shorter; of equal lengths that whose first step apart is the lower one; in one cell the one of
smaller rank). In the cell a depth-first search goes down the rest of the trie with all queries at once: at each level a
query takes the child of its own count, and while it has surplus or deficit left those one above or below. Words at the
leaves are compared letter by letter.

Words are numbered by rank (most frequent first, ties in code-point order), so the best of several near words is the
least number. Forms have at least ten times their words' occurrences, so chains are short; roots follow by doubling.

Defined cases: null and empty texts have no words; a null id counts as empty text before the colon; repeated rows count
each; extra columns are not read; an empty table gives no rows. Letters are those of A-Z, a-z and U+00C0 to U+00FF.
Memory follows the slice, ``block`` and a bounded number of open branches and pairs.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _counts, _text as T

LEAST_LETTERS, LEAST_TIMES, LEAD = 7, 2, 10
GROUPS = 12
BLOCK = 1 << 13
OPEN = 1 << 18
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
#: What a row is: a cell's word, or a query with surplus and deficit left.
WORD, MORE, EXACT, BOTH, LESS = range(5)
_SURPLUS, _DEFICIT = np.array([0, 1, 0, 1, 0]), np.array([0, 0, 0, 1, 1])


def runs(text: str) -> list[bytes]:
    """Maximal runs of letters, A-Z in lower case, one byte a letter."""
    return text.encode("latin-1", "replace").translate(_FOLD).split()


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", misspell: int = 31) -> DataFrame:
    """``word, n`` of all documents; where crc32 of ``id:run`` is divisible by ``misspell``, the run loses a letter first (0: never)."""
    texts = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in T.slices(batches, most=1 << 20):
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                begin = zlib.crc32(f"{name}:".encode())
                for w, n in Counter([w for w in runs(text or "") if len(w) >= LEAST_LETTERS]).items():
                    h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), begin)
                    if misspell and h % misspell == 0:
                        at = h % len(w)
                        w = w[:at] + w[at + 1 :]
                        if len(w) < LEAST_LETTERS:
                            continue
                    held[w] += n
            if len(held) > 1 << 19:
                yield out()
                held.clear()
        yield out()

    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_TIMES)


def _letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One byte a letter of all words, end to end, and where each begins (with an end)."""
    rows = [w.encode("latin-1") for w in column.to_pylist()]
    return np.frombuffer(b"".join(rows), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in rows])]).astype(np.int64)


def letter_groups(ranked: DataFrame, groups: int = GROUPS) -> np.ndarray:
    """The group of each of the 256 bytes: letters by their number over all words, dealt to and fro."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in batches:
            total += np.bincount(_letters(batch.column(0))[0], minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], names=["letter", "n"])

    found = ranked.select("word").mapInArrow(run, "letter long, n long").groupBy("letter").agg(F.sum("n").alias("n")).collect()  # 90 rows at most
    out = np.zeros(256, np.int64)
    for place, (letter, _) in enumerate(sorted(found, key=lambda r: (-r[1], r[0]))):
        turn, step = divmod(place, groups)
        out[letter] = step if turn % 2 == 0 else groups - 1 - step
    return out


def paths(letters: np.ndarray, offsets: np.ndarray, group_of: np.ndarray, groups: int) -> np.ndarray:
    """Length and group counts of each word, as bytes (modulo 256)."""
    per = np.diff(offsets)
    row = np.repeat(np.arange(len(per)), per)
    counts = np.bincount(row * groups + group_of[letters], minlength=len(per) * groups).reshape(-1, groups)
    return np.concatenate([per[:, None], counts], axis=1).astype(np.uint8)


def _deal(path: np.ndarray, depth: int) -> Iterator[tuple[int, np.ndarray]]:
    """What each word is sent as, and to the cells of which path beginnings."""
    own = path[:, : depth + 1]
    yield WORD, own
    yield BOTH, own
    longer = own.copy()
    longer[:, 0] += 1
    yield MORE, longer
    for i in range(1, depth + 1):
        more = longer.copy()
        more[:, i] += 1
        yield EXACT, more
        other = own.copy()
        other[:, i] += 1
        yield LESS, other
        for j in range(i + 1, depth + 1):
            both = other.copy()
            both[:, j] -= 1
            yield EXACT, both


class Cell:
    """The words of one block, as the lower levels of the trie."""

    def __init__(self, ids: np.ndarray, letters: np.ndarray, offsets: np.ndarray, path: np.ndarray, depth: int) -> None:
        rest = path[:, depth + 1 :]
        order = np.lexsort(rest.T[::-1]) if rest.shape[1] else np.arange(len(ids))
        self.ids, self.rows, self.letters, self.offsets, self.rest = ids[order], order, letters, offsets, rest[order]
        self.children: list[np.ndarray] = []
        node = np.zeros(len(ids), np.int64)
        for level in range(rest.shape[1]):
            edge = (node << 8) | self.rest[:, level]
            fresh = np.ones(len(edge), bool)
            fresh[1:] = edge[1:] != edge[:-1]
            self.children.append(edge[fresh])
            node = np.cumsum(fresh) - 1
        self.leaf = np.concatenate([np.searchsorted(node, np.arange(node[-1] + 1)), [len(ids)]])
        self.near, self.best = np.zeros(len(ids), np.int64), np.full(len(ids), np.iinfo(np.int64).max)

    def search(self, rest: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Depth first, in portions: queries and the places of words at leaves that their budgets reach."""
        stack = [(0, np.arange(len(rest)), np.zeros(len(rest), np.int64), surplus, deficit)]
        while stack:
            level, query, node, more, less = stack.pop()
            if len(query) > OPEN:
                half = len(query) // 2
                stack += [(level, query[half:], node[half:], more[half:], less[half:]), (level, query[:half], node[:half], more[:half], less[:half])]
                continue
            if level == len(self.children):
                first, count = self.leaf[node], self.leaf[node + 1] - self.leaf[node]
                total = np.cumsum(count)
                at = 0
                while at < len(query):  # portions of OPEN pairs, or one leaf
                    to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + OPEN, "right")))
                    cell, place = T.ragged(count[at:to])
                    yield query[at:to][cell], first[at:to][cell] + place
                    at = to
                continue
            edges, own, found = self.children[level], rest[query, level].astype(np.int64), []
            for change in (0, 1, -1):
                may = np.arange(len(query)) if change == 0 else np.flatnonzero(more > 0 if change > 0 else less > 0)
                want = (node[may] << 8) | ((own[may] + change) & 255)
                child = np.minimum(np.searchsorted(edges, want), len(edges) - 1)
                hit = edges[child] == want
                may, child = may[hit], child[hit]
                found.append((query[may], child, more[may] - (change > 0), less[may] - (change < 0)))
            if sum(len(f[0]) for f in found):
                stack.append((level + 1, *(np.concatenate(x) for x in zip(*found, strict=True))))

    def ask(self, ids: np.ndarray, letters: np.ndarray, offsets: np.ndarray, path: np.ndarray, kind: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query how many near words it has here, and the least of their numbers; the words' own are added up."""
        near, best = np.zeros(len(ids), np.int64), np.full(len(ids), np.iinfo(np.int64).max)
        for q, t in self.search(path[:, depth + 1 :], _SURPLUS[kind], _DEFICIT[kind]):
            keep = (kind[q] != BOTH) | (ids[q] < self.ids[t])
            q, t = q[keep], t[keep]
            hit = one_apart(letters, offsets, q, self.letters, self.offsets, self.rows[t])
            q, t = q[hit], t[hit]
            for n, low, x, other in ((near, best, q, self.ids[t]), (self.near, self.best, t, ids[q])):
                np.add.at(n, x, 1)
                np.minimum.at(low, x, other)
        return near, best


def one_apart(letters: np.ndarray, offsets: np.ndarray, x: np.ndarray, other: np.ndarray, other_offsets: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether word y is word x with exactly one letter replaced or one letter more."""
    out = np.zeros(len(x), bool)
    a, b = (offsets[x + 1] - offsets[x]), (other_offsets[y + 1] - other_offsets[y])
    for gap in (0, 1):
        fit = np.flatnonzero(b - a == gap)
        for size in np.unique(a[fit]).tolist():
            own = fit[a[fit] == size]
            step = max(1, (1 << 23) // size)
            for at in range(0, len(own), step):
                some = own[at : at + step]
                p, q = letters[offsets[x[some]][:, None] + np.arange(size)], other[other_offsets[y[some]][:, None] + np.arange(size + gap)]
                if gap == 0:
                    out[some] = (p != q).sum(axis=1) == 1
                else:  # what they share from the left and from the right covers the shorter one
                    lead = (p == q[:, :-1]).cumprod(axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
                    trail = (p == q[:, 1:])[:, ::-1].cumprod(axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
                    out[some] = lead + trail >= size
    return out


def near_words(ranked: DataFrame, groups: int = GROUPS, block: int = BLOCK) -> DataFrame:
    """``id, n_near, best`` of all words of ranked(id, word) that have near ones: how many, and the least id of them."""
    group_of = letter_groups(ranked, groups)

    def cells(depth: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own, n = np.unique(np.ascontiguousarray(paths(*_letters(batch.column(0)), group_of, groups)[:, : depth + 1]).view(f"V{depth + 1}").ravel(), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in own], pa.binary()), pa.array(n)], names=["cell", "n"])

        return ranked.select("word").mapInArrow(run, "cell binary, n long").groupBy("cell").agg(F.sum("n").alias("n"))

    depth = 2
    while (cells(depth).agg(F.max("n")).first()[0] or 0) > block and depth < groups:
        depth += 1
    large = {bytes(c): -(-n // block) for c, n in cells(depth).filter(F.col("n") > block).collect()} if depth == groups else {}  # one for each `block` words at most

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters, offsets = _letters(batch.column(1))
            path = paths(letters, offsets, group_of, groups)
            ids = batch.column(0)
            raw = pa.array([w.encode("latin-1") for w in batch.column(1).to_pylist()], pa.binary())
            for kind, key in _deal(path, depth):
                keys = [k.tobytes() for k in np.ascontiguousarray(key)]
                rows, blocks = list(range(len(keys))), [0] * len(keys)
                if large:
                    many = [large.get(k, 1) for k in keys]
                    spread = [(i, b) for i, m in enumerate(many) for b in ([hash(ids[i].as_py()) % m] if kind == WORD else range(m))]
                    rows, blocks = [i for i, _ in spread], [b for _, b in spread]
                yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in rows], pa.binary()), pa.array(blocks, pa.int32()), pa.array([kind] * len(rows), pa.int32()), ids.take(pa.array(rows, pa.int64())), raw.take(pa.array(rows, pa.int64()))], names=["cell", "block", "kind", "id", "word"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, cell = None, [], None

        def out(ids: np.ndarray, near: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
            some = near > 0
            return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(near[some]), pa.array(best[some])], names=["id", "n_near", "best"])

        def parts(rows: pa.RecordBatch) -> tuple:
            column = rows.column(4)
            letters, offsets = T.utf8(column)
            return rows.column(3).to_numpy(), letters, offsets, paths(letters, offsets, group_of, groups)

        for batch in batches:
            cells_, blocks = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            kind = batch.column(2).to_numpy()
            change = [0] + [i for i in range(1, len(batch)) if cells_[i] != cells_[i - 1] or blocks[i] != blocks[i - 1]] + [len(batch)]
            for a, b in zip(change[:-1], change[1:], strict=True):
                key = (cells_[a], blocks[a])
                if key != now:
                    if cell is not None:
                        yield out(cell.ids, cell.near, cell.best)
                    now, waiting, cell = key, [], None
                words_ = a + int((kind[a:b] == WORD).sum())  # a cell's words come before its queries
                if words_ > a:
                    waiting.append(batch.slice(a, words_ - a))
                if b > words_:
                    if waiting:
                        cell, waiting = Cell(*parts(pa.concat_batches(waiting)), depth), []
                    if cell is not None:
                        own = parts(batch.slice(words_, b - words_))
                        yield out(own[0], *cell.ask(*own, kind[words_:b], depth))
        if cell is not None:
            yield out(cell.ids, cell.near, cell.best)

    dealt = ranked.select("id", "word").mapInArrow(deal, "cell binary, block int, kind int, id long, word binary").repartition("cell", "block").sortWithinPartitions("cell", "block", "kind")
    return dealt.mapInArrow(meet, "id long, n_near long, best long").groupBy("id").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", misspell: int = 31, groups: int = GROUPS, block: int = BLOCK) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every word."""
    counted = _counts.stored(words(docs, id_col, text_col, misspell), "words")
    ranked = _counts.stored(counted.orderBy(F.col("n").desc(), "word").withColumn("id", F.monotonically_increasing_id()), "ranked")
    top = ranked.agg(F.max("n")).first()[0] or 0
    near = _counts.stored(near_words(ranked, groups, block), "near")
    led = near.join(ranked.select("id", "n"), "id").join(ranked.select(F.col("id").alias("best"), F.col("n").alias("best_n")), "best")
    lead = root = _counts.stored(led.filter(F.col("best_n") >= LEAD * F.col("n")).select("id", F.col("best").alias("to"), F.col("best_n").alias("form_n")), "lead")
    root, reached, steps = lead.select("id", "to"), 1, len(str(top))  # a chain has fewer steps than the top count has digits
    while reached < steps:
        onward = root.select(F.col("id").alias("to"), F.col("to").alias("beyond"))
        root = _counts.stored(root.join(onward, "to", "left").select("id", F.coalesce("beyond", "to").alias("to")), "root")
        reached *= 2
    name = lambda key, word: ranked.select(F.col("id").alias(key), F.col("word").alias(word))
    formed = lead.join(name("to", "form"), "to").select("id", "form", "form_n").join(root, "id").join(name("to", "root"), "to").drop("to")
    out = ranked.join(near.select("id", "n_near"), "id", "left").join(formed, "id", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
