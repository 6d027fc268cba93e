"""Joins of points and ranges of whole numbers within a key, by bins, so that one long key is many small groups.

A range of length n lies at the level of the least power of two that is not below n, in the one or two bins of that size
that it touches. A point lies in one bin of each level that ranges have (32 at most). Only what shares a key, a level
and a bin is compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _level(low: str, high: str) -> Column:
    return F.ceil(F.log2(F.greatest(F.col(high) - F.col(low) + 1, F.lit(1)))).cast("int")


def _bin(value: Column | str, level: Column | str) -> Column:
    value, level = (F.col(x) if isinstance(x, str) else x for x in (value, level))
    return F.floor(value / F.pow(F.lit(2.0), level)).cast("long")


def _levels(spans: DataFrame) -> Column:
    """The levels that spans have, as a constant: 32 numbers at most."""
    found = [r[0] for r in spans.select("_level").distinct().collect()]
    return F.array(*[F.lit(x) for x in sorted(found)]) if found else F.array().cast("array<int>")


def around(points: DataFrame, spans: DataFrame, keys: list[str], at: str, low: str, high: str) -> DataFrame:
    """Points, each with every span of its key that holds it; ranges whose end is before their start hold none."""
    held = spans.filter(F.col(low) <= F.col(high)).withColumn("_level", _level(low, high))
    dealt = held.withColumn("_bin", F.explode(F.array_distinct(F.array(_bin(low, "_level"), _bin(high, "_level")))))
    asked = points.withColumn("_level", F.explode(_levels(held))).withColumn("_bin", _bin(at, "_level"))
    return asked.join(dealt, [*keys, "_level", "_bin"]).filter(F.col(at).between(F.col(low), F.col(high))).drop("_level", "_bin")


def overlapping(ranges: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of ranges(keys, low, high, ...) and others(keys, _low, _high, ...) that meet; a pair may come twice."""
    a = ranges.filter("low <= high").withColumn("_level", _level("low", "high"))
    b = others.filter("_low <= _high").withColumn("_level", _level("_low", "_high"))
    of_b = b.withColumn("_bin", F.explode(F.array_distinct(F.array(_bin("_low", "_level"), _bin("_high", "_level")))))
    of_a = a.withColumn("_bin", F.explode(F.array_distinct(F.array(_bin("low", "_level"), _bin("high", "_level")))))

    def raised(rows: DataFrame, low: str, high: str, levels: Column, same: bool) -> DataFrame:
        """Rows in the bins, two at most, of each level from their own on (or above it)."""
        up = rows.withColumnRenamed("_level", "_own").withColumn("_level", F.explode(levels)).filter((F.col("_level") >= F.col("_own")) if same else (F.col("_level") > F.col("_own")))
        return up.drop("_own").withColumn("_bin", F.explode(F.array_distinct(F.array(_bin(low, "_level"), _bin(high, "_level")))))

    on = [*keys, "_level", "_bin"]
    pairs = raised(a, "low", "high", _levels(b), True).join(of_b, on).unionByName(of_a.join(raised(b, "_low", "_high", _levels(a), False), on))
    return pairs.filter("low <= _high and _low <= high").drop("_level", "_bin")
