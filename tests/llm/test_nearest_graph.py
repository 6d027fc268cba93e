"""The search measures many pairs and passes few on: those beyond a full beam's last place stay behind."""

import numpy as np
import pyarrow as pa

from auditlake.llm import nearest


def test_packed_vectors_as_matrix():
    for kind, mark in ((np.float32, 4), (np.float64, 8)):
        x = np.random.default_rng(5).standard_normal((9, 5)).astype(kind)
        column = pa.array([bytes([mark]) + r.tobytes() for r in x], pa.binary())
        assert (nearest._matrix(column) == x).all() and (nearest._matrix(column.slice(2, 4)) == x[2:6]).all() and not len(nearest._matrix(column.slice(9)))


def test_beyond_the_beam_nothing_is_made(spark):
    x = np.arange(1, 9, dtype=np.float64)
    packed = spark.createDataFrame([(i, bytes([8]) + v.tobytes()) for i, v in enumerate(x)], "node long, p binary")
    queries = spark.createDataFrame([(0, bytes([8]) + x[0].tobytes(), 9.0)], "q long, qp binary, worst double")
    pairs = spark.createDataFrame([(0, i) for i in range(8)], "q long, node long")
    assert sorted(r.d for r in nearest._measured(pairs, queries, packed).collect()) == [0, 1, 4, 9]


def test_old_entries_do_not_meet_again(spark):
    x = np.random.default_rng(7).standard_normal((6, 3))
    packed = spark.createDataFrame([(i, bytes([8]) + v.tobytes()) for i, v in enumerate(x)], "node long, p binary")
    for fresh, pairs in ((set(), set()), ({1}, {(1, 2), (1, 3), (2, 1), (3, 1)}), ({1, 2, 3}, {(a, b) for a in (1, 2, 3) for b in (1, 2, 3) if a != b})):
        graph = spark.createDataFrame([(0, v, float(((x[0] - x[v]) ** 2).sum()), v in fresh) for v in (1, 2, 3)], "u long, v long, d double, fresh boolean")
        assert {(r.u, r.v) for r in nearest._descend(graph, packed, 4).collect()} == pairs


def test_trees_keep_up_with_depth(spark, monkeypatch):
    x = np.random.default_rng(3).standard_normal((3000, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    packed = spark.createDataFrame([(i, bytes([8]) + v.tobytes()) for i, v in enumerate(x)], "node long, p binary").cache()
    exact = np.argsort(nearest._squares(x), axis=1)[:, : nearest.DEGREE]
    monkeypatch.setattr(nearest, "BLOCK", 128)
    found = {(r.u, r.v) for r in nearest._first_graph(packed, len(x), nearest.DEGREE).collect()}
    assert np.mean([(u, int(v)) in found for u, vs in enumerate(exact) for v in vs]) > 0.985
