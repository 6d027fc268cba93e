"""Running values along the rows of a key, cut into pieces, so that a key of any length is the work of many tasks.

``order`` is a column of integers, distinct within a key; a piece is ``piece`` successive values of it. Each piece is
scanned by itself; what the pieces before it come to is a scan over one row for each piece, joined back. Rows with a
null key are kept, each piece of them by itself. Where ``piece`` is None keys are known to be short and are not cut:
one scan for each, which needs no other dealing than by the key.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

PIECE = 1 << 14


def _cut(df: DataFrame, order: str, piece: int) -> DataFrame:
    return df.withColumn("_piece", F.floor(F.col(order) / piece))


def running(df: DataFrame, keys: list[str], order: str, step: Column, name: str, low: str | None = None, piece: int | None = PIECE) -> DataFrame:
    """Adds ``name``, the sum of ``step`` up to and with each row, and ``low``, the least such sum so far."""
    if piece is None:
        whole = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        out = df.withColumn("_step", step).withColumn(name, F.sum("_step").over(whole)).drop("_step")
        return out.withColumn(low, F.min(name).over(whole)) if low else out
    cut = _cut(df, order, piece).withColumn("_step", step)
    within = Window.partitionBy(*keys, "_piece").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    own = cut.withColumn("_sum", F.sum("_step").over(within))
    pieces = own.groupBy(*keys, "_piece").agg(F.sum("_step").alias("_total"), F.min("_sum").alias("_least"))
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_base", F.coalesce(F.sum("_total").over(before), F.lit(0)))
    pieces = pieces.withColumn("_floor", F.min(F.col("_base") + F.col("_least")).over(before)).select(*keys, "_piece", "_base", "_floor")
    out = _joined(own, pieces, keys).withColumn(name, F.coalesce("_base", F.lit(0)) + F.col("_sum"))
    if low:
        out = out.withColumn(low, F.least(F.coalesce("_base", F.lit(0)) + F.min("_sum").over(within), "_floor"))
    return out.drop("_piece", "_step", "_sum", "_base", "_floor")


def last_mark(df: DataFrame, keys: list[str], order: str, mark: Column, name: str, own: bool = True, reverse: bool = False, piece: int | None = PIECE) -> DataFrame:
    """Adds ``name``: the last ``mark`` that is not null up to each row (with ``own``: or on it); in reverse, the next one."""
    if piece is None:
        whole = Window.partitionBy(*keys).orderBy(F.desc(order) if reverse else order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
        return df.withColumn("_mark", mark).withColumn(name, F.last("_mark", ignorenulls=True).over(whole)).drop("_mark")
    at = -F.col(order) if reverse else F.col(order)
    cut = _cut(df.withColumn("_at", at), "_at", piece).withColumn("_mark", mark)
    within = Window.partitionBy(*keys, "_piece").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    marked = cut.withColumn("_own", F.last("_mark", ignorenulls=True).over(within))
    pieces = cut.groupBy(*keys, "_piece").agg(F.max_by("_mark", F.when(F.col("_mark").isNotNull(), F.col("_at"))).alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_carried", F.last("_last", ignorenulls=True).over(before)).select(*keys, "_piece", "_carried")
    return _joined(marked, pieces, keys).withColumn(name, F.coalesce("_own", "_carried")).drop("_piece", "_at", "_mark", "_own", "_carried")


def _joined(rows: DataFrame, pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with their piece's columns; both sides are already dealt alike, so only the pieces move."""
    return rows.join(pieces, [*keys, "_piece"], "left")


def _with_copies(df: DataFrame, order: str, before: int, after: int, piece: int) -> DataFrame:
    """Rows by piece, with marked copies of those that pieces next to theirs look at."""
    if max(before, after) > piece:
        raise ValueError("a piece must be as long as what is looked at around a row")
    cut = _cut(df, order, piece).withColumn("_copy", F.lit(False))
    place, every = F.pmod(F.col(order), F.lit(piece)), cut
    for near, move in ((place >= piece - before, 1), (place < after, -1)):
        every = every.unionByName(cut.filter(near).withColumns({"_piece": F.col("_piece") + move, "_copy": F.lit(True)}))
    return every


def lines_around(df: DataFrame, keys: list[str], order: str, value: str, before: int, after: int, name: str, piece: int = PIECE, of: Column | None = None) -> DataFrame:
    """Adds ``name``: in order, the values of the rows from ``before`` numbers ahead of each row's to ``after`` behind it.

    With ``of`` only rows where it holds come out, and pieces without any are left out before values are gathered.
    """
    by = Window.partitionBy(*keys, "_piece").orderBy(order)
    every = _with_copies(df, order, before, after, piece)
    if of is not None:
        every = every.withColumn("_of", F.coalesce(of, F.lit(False)) & ~F.col("_copy"))
        whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        every = every.withColumn("_any", F.max("_of").over(whole)).filter("_any").drop("_any")
    out = every.withColumn(name, F.collect_list(value).over(by.rangeBetween(-before, after))).filter("not _copy")
    return (out if of is None else out.filter("_of").drop("_of")).drop("_piece", "_copy")


def next_within(df: DataFrame, keys: list[str], order: str, reach: int, name: str, piece: int = PIECE) -> DataFrame:
    """Adds ``name``: the order of a key's next row, where it comes within ``reach``; of later ones it may be null."""
    w = Window.partitionBy(*keys, "_piece").orderBy(order)
    return _with_copies(df, order, 0, reach, piece).withColumn(name, F.lead(order).over(w)).filter("not _copy").drop("_piece", "_copy")


def next_not_above(df: DataFrame, keys: list[str], order: str, value: str, stops: Column, name: str, piece: int = PIECE) -> DataFrame:
    """Adds ``name``: the order of the next row of the key where ``stops`` holds and ``value`` is no more than the row's own.

    Within a piece a stack of rows that ascend in value is kept from the end on, so each row is looked at once. What is
    left open at a piece's end, a row for each value at most, meets the first later piece with a value as low.
    """
    cut = _cut(df, order, piece).withColumn("_stops", F.coalesce(stops, F.lit(False)))
    sorted_ = cut.repartition(*keys, "_piece").sortWithinPartitions(*keys, "_piece", F.desc(order))
    places = [sorted_.columns.index(c) for c in (*keys, "_piece")]
    at, low, stop = (sorted_.columns.index(c) for c in (order, value, "_stops"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stack = None, []
        for batch in batches:
            out = []
            for key, n, v, s in zip(zip(*(batch.column(i).to_pylist() for i in places), strict=True), batch.column(at).to_pylist(), batch.column(low).to_pylist(), batch.column(stop).to_pylist(), strict=True):
                if key != now:
                    now, stack = key, []
                i = bisect_right(stack, (v, float("inf")))
                out.append(stack[i - 1][1] if i else None)
                if s:  # it hides all rows behind it that are no lower
                    del stack[bisect_left(stack, (v, float("-inf"))) :]
                    stack.append((v, n))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, "_own"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sorted_.schema.fields)
    near = sorted_.mapInArrow(run, f"{schema}, _own long")
    lows = cut.filter("_stops").groupBy(*keys, "_piece").agg(F.min(value).alias("_low"))
    later = lows.withColumnRenamed("_piece", "_later")
    left = near.filter("_own is null").select(*keys, "_piece", F.col(value).alias("_value")).distinct()
    met = left.join(later, keys).filter("_later > _piece and _low <= _value").groupBy(*keys, "_piece", "_value").agg(F.min("_later").alias("_later"))
    rows = cut.filter("_stops").select(*keys, F.col("_piece").alias("_later"), F.col(order).alias("_n"), F.col(value).alias("_v"))
    far = met.join(rows, [*keys, "_later"]).filter("_v <= _value").groupBy(*keys, "_piece", "_value").agg(F.min("_n").alias("_far"))
    joined = near.withColumn("_value", F.col(value)).join(far, [*keys, "_piece", "_value"], "left")
    return joined.withColumn(name, F.coalesce("_own", "_far").cast("int")).drop("_piece", "_stops", "_own", "_value", "_far")
