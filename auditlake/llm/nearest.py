"""Approximate nearest neighbours: an NN-descent graph built by Spark joins, searched greedily.

Equal vectors form one node. Random-projection trees, fitted on at most ``SAMPLE`` nodes, deal all nodes into leaves;
nodes of a leaf are compared in blocks of at most ``BLOCK``, which gives each node its first ``degree`` neighbours. Trees
are many, as a leaf costs one matrix product and a descent round ships each vector to all lists that hold it (as many as
``2 * degree`` trees). A level more parts more neighbours, so trees grow with depth and a larger table needs no more rounds.
Each NN-descent round joins neighbours of neighbours: at every node its forward neighbours and nearest backward ones
meet, but for pairs of entries that both stood there before, and each pair that improves a list replaces an entry. Rounds go on until few entries change. Vectors are worked
on as they are given (4 bytes a component, 8 for doubles) and compared in double precision, so neither their scale nor
an offset matters.

Search: every query starts at its entry node (its own node if it is indexed), and in each round all nodes of its
beam not yet expanded bring their neighbours and nearest backward ones; it stops when no query has any left. The
graph's degree and the beam are what makes the search approximate, and how wide a beam must be depends on the vectors.
So the exact neighbours of at most ``PROBES`` queries are found in one scan, and these queries are searched with a beam
that is doubled until ``TARGET`` of them are found; all queries are then searched once with that beam, each from its own
node and ``ENTRIES`` fixed ones. Beyond ``MOST_BEAM`` all queries are compared with all vectors, in blocks.

Rows take no part whose vector is null, empty, all zero, holds a null or non-finite component, or has another length
than most. Defined cases: repeated vectors share a node and rank by id; a null id takes no part; of rows with one
id and different vectors all count; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window, functions as F

from ..shared import discard, materialize

DEGREE, SAMPLE, BLOCK, BEAM = 24, 4096, 1024, 64
TREES, LEVEL_TREES, MOST_TREES = 24, 8, 64  # at least; for each level; at most
LISTS = 1024  # lists of one node's neighbours that a task opens at a time
PROBES, TARGET, MOST_BEAM, ENTRIES = 64, 0.95, 512, 8
MOST_ROUNDS = 100  # of descent or search; both settle in a few, and raise rather than stop unsettled


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of packed vectors as a matrix; a first byte tells how wide components are."""
    n = len(column)
    if not n:
        return np.zeros((0, 1))
    column = column.cast(pa.large_binary())
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].reshape(n, -1)  # all are of one length
    return np.ascontiguousarray(raw[:, 1:]).view(np.float64 if raw[0, 0] == 8 else np.float32).astype(np.float64)


def valid_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, v`` (array<double>), ``node`` (its fingerprint) of the rows that take part."""
    v = F.col("v")
    ok = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & v.isNotNull())
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = ok.filter(~bad & F.exists(v, lambda x: x != 0))
    common = ok.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return ok.filter(F.size("v") == (common[0] if common else 0)).withColumn("node", F.xxhash64("v"))


def _with_packed(rows: DataFrame, double: bool) -> DataFrame:
    """``node, p``: the vector's components as bytes."""
    kind = np.float64 if double else np.float32
    mark = bytes([np.dtype(kind).itemsize])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            x = flat.astype(kind).reshape(n, -1) if n else np.zeros((0, 1), kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([mark + r.tobytes() for r in x], pa.binary())], names=["node", "p"])

    return rows.select("node", "v").mapInArrow(run, "node long, p binary")


class _Trees:
    """Random-projection trees, fitted on a bounded sample.

    The first ``fitted`` levels cut each node at its sample's median. Deeper ones, which a sample cannot fit, share one
    direction and cut a level.
    """

    def __init__(self, sample: np.ndarray, depth: int, trees: int, most: int = 10) -> None:
        rng = np.random.Generator(np.random.PCG64(17))
        self.depth, self.fitted, dim = depth, min(depth, most), sample.shape[1]
        self.normal = np.zeros((trees, 1 << self.fitted, dim))
        self.cut = np.zeros((trees, 1 << self.fitted))
        self.deep = np.zeros((trees, depth - self.fitted, dim))
        self.deep_cut = np.zeros((trees, depth - self.fitted))
        for t in range(trees):
            at = np.ones(len(sample), np.int64)
            for node in range(1, 1 << self.fitted):
                mine = np.flatnonzero(at == node)
                own = sample[mine]
                w = np.subtract(*own[rng.choice(len(own), 2, replace=False)]) if len(own) > 1 else np.zeros(dim)
                if not w.any():
                    w = rng.standard_normal(dim)
                self.normal[t, node] = w
                self.cut[t, node] = np.median(own @ w) if len(own) else 0
                at[mine] = 2 * node + (own @ w > self.cut[t, node])
            for level in range(depth - self.fitted):
                w = np.subtract(*sample[rng.choice(len(sample), 2)])
                self.deep[t, level] = w
                self.deep_cut[t, level] = np.median(sample @ w)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        out = np.ones((len(self.normal), len(x)), np.int64)
        for t in range(len(out)):
            for _ in range(self.fitted):
                w, c = self.normal[t][out[t]], self.cut[t][out[t]]
                out[t] = 2 * out[t] + (np.einsum("ij,ij->i", x, w) > c)
            for w, c in zip(self.deep[t], self.deep_cut[t], strict=True):
                out[t] = 2 * out[t] + (x @ w > c)
        return out


def _squares(x: np.ndarray) -> np.ndarray:
    """Squared distances between all rows; taken from their mean, which keeps digits where vectors have an offset."""
    x = x - x.mean(axis=0)
    square = (x * x).sum(axis=1)
    far = np.maximum(square[:, None] + square[None] - 2 * (x @ x.T), 0)
    np.fill_diagonal(far, np.inf)
    return far


def _block_edges(ids: np.ndarray, x: np.ndarray, degree: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's nearest others within a block."""
    n, k = len(ids), min(degree, len(ids) - 1)
    if k <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    far = _squares(x)
    near = np.argpartition(far, k - 1, axis=1)[:, :k]
    return np.repeat(ids, k), ids[near].ravel(), np.take_along_axis(far, near, 1).ravel()


def _edges(u, v, d) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(d, pa.float64())], names=["u", "v", "d"])


def _best(edges: DataFrame, degree: int, by: str = "u") -> DataFrame:
    """The ``degree`` nearest entries of each list; ties to the smaller node."""
    other = "v" if by == "u" else "u"
    rank = F.row_number().over(Window.partitionBy(by).orderBy("d", other))
    return edges.groupBy("u", "v").agg(F.min("d").alias("d")).withColumn("r", rank).filter(F.col("r") <= degree).drop("r")


def _first_graph(packed: DataFrame, n: int, degree: int) -> DataFrame:
    sample = _matrix(packed.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("p").toArrow().column(0).combine_chunks())
    depth = max(0, math.ceil(math.log2(max(n, 1) / (BLOCK * 0.8))))
    each = -(-degree // (3 if depth > 3 else 2)) if depth else degree  # the trees together give more than a list holds
    count = min(max(TREES, LEVEL_TREES * depth), MOST_TREES) if depth else 1
    trees = packed.sparkSession.sparkContext.broadcast(_Trees(sample, depth, count))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = trees.value.leaves(_matrix(batch.column(1)))
            for t, leaf in enumerate(leaves):
                yield pa.RecordBatch.from_arrays([pa.array(leaf + (t << 56)), batch.column(0), batch.column(1)], names=["leaf", "node", "p"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, object]] = []

        def flush() -> pa.RecordBatch:
            ids = np.array([h[1] for h in held], np.int64)
            out = _edges(*_block_edges(ids, _matrix(pa.array([h[2] for h in held], pa.binary())), each))
            held.clear()
            return out

        for batch in batches:
            for leaf, node, p in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (held[0][0] != leaf or len(held) >= BLOCK):
                    yield flush()
                held.append((leaf, node, p))
        if held:
            yield flush()

    dealt = packed.mapInArrow(deal, "leaf long, node long, p binary").repartition("leaf").sortWithinPartitions("leaf", F.xxhash64("node"))
    return _best(dealt.mapInArrow(compare, "u long, v long, d double"), degree)


def _descend(graph: DataFrame, packed: DataFrame, degree: int) -> DataFrame:
    """Entries that one round of neighbours of neighbours proposes: those nearer than a list's last.

    Of a list's pairs those meet that an entry marked ``fresh`` takes part in; two old entries have met in a round before.
    """
    worst = graph.groupBy("u").agg(F.when(F.count("*") >= degree, F.max("d")).otherwise(F.lit(float("inf"))).alias("worst"))
    info = packed.join(worst, F.col("node") == F.col("u"), "left").select("node", "p", F.coalesce("worst", F.lit(float("inf"))).alias("worst"))
    rank = F.row_number().over(Window.partitionBy("v").orderBy("d", "u"))
    back = graph.withColumn("r", rank).filter(F.col("r") <= degree).select(F.col("v").alias("c"), F.col("u").alias("node"), "fresh")
    meet = graph.select(F.col("u").alias("c"), F.col("v").alias("node"), "fresh").unionByName(back)
    lists = meet.join(info, "node").groupBy("c").agg(F.collect_list(F.struct("node", "p", "worst", "fresh")).alias("x"))  # 2 * degree at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lists in (batch.column(0).slice(at, LISTS) for batch in batches for at in range(0, len(batch), LISTS)):
            flat, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
            nodes, x, worst = flat.field(0).to_numpy(), _matrix(flat.field(1)), flat.field(2).to_numpy()
            fresh = flat.field(3).to_numpy(zero_copy_only=False).astype(bool)
            us, vs, ds, at = [], [], [], 0
            for m in sizes.tolist():
                new = fresh[at : at + m]
                if new.any():
                    far = _squares(x[at : at + m])
                    own = nodes[at : at + m]  # one that is a neighbour both ways stands twice
                    use = np.zeros(m, bool)
                    use[np.unique(own, return_index=True)[1]] = True
                    new = np.isin(own, own[new])
                    i, j = np.nonzero((far < worst[at : at + m, None]) & use[:, None] & use[None] & (new[:, None] | new[None]))
                    us.append(nodes[at + i])
                    vs.append(nodes[at + j])
                    ds.append(far[i, j])
                at += m
            yield _edges(*(np.concatenate(z) if z else [] for z in (us, vs, ds)))

    return lists.select("x").mapInArrow(run, "u long, v long, d double")


def build_graph(packed: DataFrame, degree: int = DEGREE, settle: float = 0.02) -> DataFrame:
    """``u, v, d``: each node's nearest neighbours found, d the squared distance; rounds end when under ``settle`` of all entries change."""
    n = packed.count()
    graph = materialize(_first_graph(packed, n, degree).withColumn("fresh", F.lit(True)), "nn-graph")
    rank = F.row_number().over(Window.partitionBy("u").orderBy("d", "v"))
    for _ in range(MOST_ROUNDS):
        proposed = graph.withColumn("fresh", F.lit(False)).unionByName(_descend(graph, packed, degree).withColumn("fresh", F.lit(True)))
        merged = proposed.groupBy("u", "v").agg(F.min("d").alias("d"), F.min("fresh").alias("fresh"))
        seen = Observation()
        better = merged.withColumn("r", rank).filter(F.col("r") <= degree).drop("r").observe(seen, F.count_if("fresh").alias("changed"))
        after = materialize(better, "nn-graph")
        discard(graph)
        graph = after
        if seen.get["changed"] <= settle * n * degree:
            return graph.drop("fresh")
    raise RuntimeError(f"the graph did not settle in {MOST_ROUNDS} rounds")


def _measured(pairs: DataFrame, queries: DataFrame, packed: DataFrame) -> DataFrame:
    """Squared distances of (q, node) pairs, of those that are not beyond ``worst``; ``queries`` has q, its packed vector qp and worst."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = ((_matrix(batch.column(2)) - _matrix(batch.column(3))) ** 2).sum(axis=1)
            near = pa.array(d <= batch.column(4).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d)], names=["q", "node", "d"]).filter(near)

    return pairs.join(packed, "node").join(queries, "q").select("q", "node", "p", "qp", "worst").mapInArrow(run, "q long, node long, d double")


def greedy_search(graph: DataFrame, packed: DataFrame, queries: DataFrame, entries: DataFrame, beam: int = BEAM, degree: int = DEGREE) -> DataFrame:
    """``q, node, d``: the beam of each query (q, qp) when the search from ``entries`` (q, node) has settled."""
    back = _best(graph, 2 * degree, "v")  # the nearest of those that list a node, so that no hub brings very many
    both = materialize(graph.select("u", "v").unionByName(back.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "nn-both")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("d", "node"))
    anything = queries.withColumn("worst", F.lit(float("inf")))
    state = materialize(_measured(entries.distinct(), anything, packed).withColumn("done", F.lit(False)), "nn-beam")
    for _ in range(MOST_ROUNDS):
        fresh = state.filter("not done").join(both, F.col("node") == F.col("u")).select("q", F.col("v").alias("node")).distinct()
        fresh = fresh.join(state.select("q", "node"), ["q", "node"], "left_anti")
        # What is beyond the last place of a full beam is measured and goes no further.
        worst = state.groupBy("q").agg(F.when(F.count("*") >= beam, F.max("d")).otherwise(F.lit(float("inf"))).alias("worst"))
        found = _measured(fresh, queries.join(worst, "q"), packed).withColumn("done", F.lit(False))
        seen = Observation()
        kept = state.select("q", "node", "d", F.lit(True).alias("done")).unionByName(found).withColumn("r", rank).filter(F.col("r") <= beam).drop("r")
        after = materialize(kept.observe(seen, F.count_if(~F.col("done")).alias("left")), "nn-beam")
        discard(state)
        state = after
        if not seen.get["left"]:
            discard(both)
            return state.select("q", "node", "d")
    raise RuntimeError(f"the search did not settle in {MOST_ROUNDS} rounds")


def exact_search(packed: DataFrame, queries: DataFrame, k: int, block: int = 1024) -> DataFrame:
    """``q, node, d``: the k nearest other nodes of each query (q, qp), all compared in blocks of queries."""
    count = -(-queries.count() // block)
    dealt = queries.withColumn("part", F.pmod(F.xxhash64("q"), F.lit(max(count, 1)))) if count > 1 else queries.withColumn("part", F.lit(0))
    rank, out = F.row_number().over(Window.partitionBy("q").orderBy("d", "node")), None
    for part in range(max(count, 1)):
        held = dealt.filter(F.col("part") == part).select("q", "qp").toArrow()  # about `block` queries
        shared = packed.sparkSession.sparkContext.broadcast((held.column(0).to_numpy(), _matrix(held.column(1).combine_chunks())))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            for batch in batches:
                nodes, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
                if not len(ids) or not len(nodes):
                    continue
                middle = x.mean(axis=0)
                far = np.maximum(((q - middle) ** 2).sum(axis=1)[:, None] + ((x - middle) ** 2).sum(axis=1)[None] - 2 * (q - middle) @ (x - middle).T, 0)
                far[ids[:, None] == nodes[None]] = np.inf
                m = min(k, len(nodes))
                near = np.argpartition(far, m - 1, axis=1)[:, :m]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, m)), pa.array(nodes[near].ravel()), pa.array(np.take_along_axis(far, near, 1).ravel())], names=["q", "node", "d"])

        found = packed.select("node", "p").mapInArrow(run, "q long, node long, d double").filter("d < double('infinity')")
        found = found.withColumn("r", rank).filter(F.col("r") <= k).drop("r")
        out = found if out is None else out.unionByName(found)
    return out


def settled_search(graph: DataFrame, packed: DataFrame, queries: DataFrame, k: int, beam: int = BEAM, degree: int = DEGREE, target: float = TARGET) -> DataFrame:
    """``q, node, d`` of :func:`greedy_search`, with as wide a beam as finds ``target`` of the exact neighbours of some queries."""
    probes = materialize(queries.orderBy(F.xxhash64("q"), "q").limit(PROBES), "nn-probes")
    exact = materialize(exact_search(packed, probes, k).select("q", "node"), "nn-exact")
    wanted, beam = exact.count(), max(beam, k + 1)
    others = packed.orderBy(F.xxhash64("node"), "node").limit(ENTRIES).select("node")
    entries = lambda of: of.select("q", F.col("q").alias("node")).unionByName(of.select("q").crossJoin(F.broadcast(others)))
    while beam <= MOST_BEAM:  # the probes alone are searched until the beam is wide enough, then all queries once
        found = greedy_search(graph, packed, probes, entries(probes), beam, degree)
        if exact.join(F.broadcast(found.select("q", "node")), ["q", "node"], "left_semi").count() >= target * wanted:  # PROBES beams at most
            return greedy_search(graph, packed, queries, entries(queries), beam, degree)
        beam *= 2
    own = queries.select("q", F.col("q").alias("node"), F.lit(0.0).alias("d"))  # other rows with the query's own vector
    return materialize(exact_search(packed, queries, k).unionByName(own), "nn-beam")


def nearest(rows: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, degree: int = DEGREE, beam: int = BEAM, target: float = TARGET) -> DataFrame:
    """``query_id, rank, vec_id, score``: for ids divisible by ``every`` their k nearest other rows found, by Euclidean distance."""
    live = materialize(valid_vectors(rows, id_col, vector_col), "nn-rows")
    double = rows.schema[vector_col].dataType.simpleString() != "array<float>"
    packed = materialize(_with_packed(live.groupBy("node").agg(F.first("v").alias("v")), double), "nn-packed")
    graph = build_graph(packed, degree)
    asked = live.filter(F.col("id") % every == 0)
    queries = materialize(asked.select("node").distinct().join(packed, "node").select(F.col("node").alias("q"), F.col("p").alias("qp")), "nn-queries")  # equal vectors share a search
    beams = settled_search(graph, packed, queries, k, beam, degree, target)
    few = live.select("id", "node").withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("id"))).filter(F.col("r") <= k + 1).select("id", "node")
    # The members of the beam's nodes, measured on the original vectors.
    ids = asked.select(F.col("id").alias("query_id"), F.col("node").alias("q"), F.col("v").alias("vq"))
    pairs = beams.select("q", "node").join(few, "node").join(live, ["id", "node"]).join(ids, "q").filter("query_id <> id")
    apart = F.sqrt(F.aggregate(F.zip_with("vq", "v", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    found = pairs.select("query_id", "id", apart.alias("score")).withColumn("rank", rank).filter(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def brute_force(rows: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100) -> DataFrame:
    """The exact answer, for measuring recall: queries against all rows in blocks, by numpy."""
    live = valid_vectors(rows, id_col, vector_col)
    asked = live.filter(F.col("id") % every == 0).toArrow()
    qid = asked.column(0).to_numpy()
    q = np.array(asked.column(1).to_pylist(), np.float64).reshape(len(qid), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), np.float64).reshape(len(batch), -1)
            for at in range(0, len(q), 64):
                far = np.sqrt(((q[at : at + 64, None] - x[None]) ** 2).sum(axis=2)) if len(x) * x.shape[1] < 1 << 18 else np.sqrt(np.maximum(((q[at : at + 64] ** 2).sum(1))[:, None] + (x**2).sum(1)[None] - 2 * q[at : at + 64] @ x.T, 0))
                far[qid[at : at + 64, None] == ids[None]] = np.inf
                m = min(k, far.shape[1])
                near = np.argpartition(far, m - 1, axis=1)[:, :m]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid[at : at + 64], m)), pa.array(ids[near].ravel()), pa.array(np.take_along_axis(far, near, 1).ravel())], names=["query_id", "vec_id", "score"])

    got = live.mapInArrow(run, "query_id long, vec_id long, score double").filter("score < double('infinity')")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return got.withColumn("rank", rank).filter(F.col("rank") <= k)
