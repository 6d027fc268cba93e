"""Connected components by large-star / small-star rounds, each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from ..shared import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round. Large: each node links its larger neighbours to its least neighbour; small: the rest."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    out = both.join(least, "u").select("v", "m", "u")
    if large:
        out = out.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = out.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected_components(edges: DataFrame, left: str = "a", right: str = "b", max_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of an undirected edge table; component is the least node of its part.

    Nulls and self-links are dropped, repeated links count once, an empty table gives no rows. The number of
    rounds grows with the logarithm of the longest path. Raises if it hasn't settled in ``max_rounds``.
    """
    x, y = F.col(left), F.col(right)
    now = edges.filter(x.isNotNull() & y.isNotNull() & (x != y))

    def keep(table: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        out = materialize(table.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")), "edges")
        return out, (seen.get["n"], seen.get["sum"])

    now, before = keep(now.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct())
    for _ in range(max_rounds):
        if not before[0]:
            break
        former = now
        now, after = keep(_star(_star(now, True), False))
        discard(former)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    tops = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(tops)
