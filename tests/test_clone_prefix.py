"""Near-duplicate pairs deal prefixes only, in any order of shingles, and lose no pair."""

import random

import numpy as np
import pytest

from auditlake.operators import clones


def sets(spark):
    rng = random.Random(11)
    base = [[rng.randrange(400) for _ in range(rng.randint(1, 60))] for _ in range(12)]
    made = [[x if rng.random() > 0.06 else rng.randrange(400) for x in rng.choice(base)] for _ in range(150)] + [[], [1], [1]]
    held = [sorted({str(x) for x in m}) for m in made]
    return held, spark.createDataFrame([(i, ",".join(h), h) for i, h in enumerate(held)], "id long, structural_hash string, shingles array<string>")


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
@pytest.mark.parametrize("sampled", [1, 64])
def test_pairs_equal_brute_force(spark, monkeypatch, threshold, sampled):
    monkeypatch.setattr(clones, "SAMPLED", sampled)
    held, df = sets(spark)
    first = {",".join(h): i for i, h in reversed(list(enumerate(held)))}
    one = [(i, set(held[i])) for i in sorted(first.values()) if held[i]]
    want = {(i, j) for k, (i, a) in enumerate(one) for j, b in one[k + 1 :] if len(a & b) >= threshold * len(a | b) - 1e-9}
    assert {(r.left, r.right) for r in clones.near_duplicate_pairs(df, threshold).collect()} == want


def test_prefixes_are_a_share_of_the_sets(spark):
    df = spark.createDataFrame([("a", 1, list(range(100))), ("b", 2, []), ("c", 3, [7])], "structural_hash string, id long, shingles array<long>")
    got = {r.id: r for r in clones._with_prefix(df, 0.8, np.arange(90)).collect()}
    assert got[1].n == 100 and got[1].prefix == [*range(90, 100), *range(11)]
    assert got[2].prefix == [] and got[3].prefix == [7]
