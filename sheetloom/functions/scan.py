"""Ordered scans that never put a whole key group into one task.

A plain ``Window.partitionBy(key)`` sorts every row of a key in one task, so one
page or sheet with a third of the corpus would stall the job.  Here a group is cut
into position blocks.  The main window runs inside ``(key, block)``; afterwards one
or two edge rows per block are brought together per key to pass values across the
block borders.  Each helper is one straight chain of windows: the input is
computed once, nothing is joined back, and results are exact.  ``block=None`` is
for keys that are bounded (a line, a page): one plain window, one sort.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 8192
BEFORE = (W.unboundedPreceding, -1)
UP_TO_HERE = (W.unboundedPreceding, 0)


def _blocked(df: DataFrame, pos: str, block: int) -> DataFrame:
    return df.withColumn("_blk", F.floor(F.col(pos) / F.lit(block)).cast("long"))


def with_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    cols: Sequence[str],
    prev: str | None = "prev",
    nxt: str | None = None,
    tie: Sequence[str] = (),
    block: int | None = BLOCK,
) -> DataFrame:
    """Attach structs of the previous / next row of the key in ``(pos, *tie)`` order."""
    order = [pos, *tie]
    if block is None:
        whole, row = W.partitionBy(*keys).orderBy(*order), F.struct(*[F.col(c) for c in cols])
        d = df.withColumn(prev, F.lag(row).over(whole)) if prev else df
        return d.withColumn(nxt, F.lead(row).over(whole)) if nxt else d
    inner = W.partitionBy(*keys, "_blk").orderBy(*order)
    d = _blocked(df, pos, block).withColumn("_p", F.struct(*[F.col(c) for c in cols]))
    d = d.withColumn("_a", F.lag("_p").over(inner)).withColumn("_z", F.lead("_p").over(inner))
    # first and last rows of the blocks share the null group, inner rows stay in their block
    d = d.withColumn("_g", F.when(F.col("_a").isNotNull() & F.col("_z").isNotNull(), F.col("_blk")))
    edge = W.partitionBy(*keys, "_g").orderBy(*order)
    if prev:
        d = d.withColumn(prev, F.coalesce("_a", F.lag("_p").over(edge)))
    if nxt:
        d = d.withColumn(nxt, F.coalesce("_z", F.lead("_p").over(edge)))
    return d.drop("_blk", "_p", "_a", "_z", "_g")


def _with_carry(
    d: DataFrame, keys: Sequence[str], order: Sequence[str], tail: Column, combine: Callable[[Column], Column]
) -> DataFrame:
    """Add ``_carry``: ``combine`` of the block totals ``tail`` over all earlier blocks of the key."""
    inner = W.partitionBy(*keys, "_blk").orderBy(*order)
    whole = W.partitionBy(*keys, "_blk")
    d = d.withColumn("_tail", tail).withColumn("_first", F.row_number().over(inner) == 1)
    d = d.withColumn("_g", F.when(~F.col("_first"), F.col("_blk")))
    heads = W.partitionBy(*keys, "_g").orderBy(*order).rowsBetween(*BEFORE)
    d = d.withColumn("_seen", combine(F.when(F.col("_first"), F.col("_tail"))).over(heads))
    d = d.withColumn("_carry", F.max(F.when(F.col("_first"), F.col("_seen"))).over(whole))
    return d.drop("_tail", "_first", "_g", "_seen")


def with_segment_start(
    df: DataFrame, keys: Sequence[str], pos: str, flag: Column, name: str = "seg", block: int | None = BLOCK
) -> DataFrame:
    """Attach the position of the latest flagged row at or before each row (null before the first)."""
    if block is None:
        return df.withColumn(name, F.max(F.when(flag, F.col(pos))).over(W.partitionBy(*keys).orderBy(pos).rowsBetween(*UP_TO_HERE)))
    d = _blocked(df, pos, block).withColumn("_mark", F.when(flag, F.col(pos)))
    inner = W.partitionBy(*keys, "_blk").orderBy(pos).rowsBetween(*UP_TO_HERE)
    d = d.withColumn("_here", F.max("_mark").over(inner))
    d = _with_carry(d, keys, [pos], F.max("_mark").over(W.partitionBy(*keys, "_blk")), F.max)
    return d.withColumn(name, F.coalesce("_here", "_carry")).drop("_blk", "_mark", "_here", "_carry")


def with_running_sum(
    df: DataFrame, keys: Sequence[str], pos: str, value: Column, name: str, tie: Sequence[str] = (), block: int | None = BLOCK
) -> DataFrame:
    """Running sum of ``value`` up to and including each row in ``(pos, *tie)`` order."""
    order = [pos, *tie]
    d = _blocked(df, pos, block).withColumn("_v", value)
    d = d.withColumn("_here", F.sum("_v").over(W.partitionBy(*keys, "_blk").orderBy(*order).rowsBetween(*UP_TO_HERE)))
    d = _with_carry(d, keys, order, F.sum("_v").over(W.partitionBy(*keys, "_blk")), F.sum)
    return d.withColumn(name, F.col("_here") + F.coalesce("_carry", F.lit(0))).drop("_blk", "_v", "_here", "_carry")


def with_row_number(
    df: DataFrame, keys: Sequence[str], pos: str, name: str = "rn", tie: Sequence[str] = (), block: int | None = BLOCK
) -> DataFrame:
    """Row number inside each key in ``(pos, *tie)`` order."""
    if block is None:
        return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(pos, *tie)).cast("long"))
    d = with_running_sum(df, keys, pos, F.lit(1), name, tie, block)
    return d.withColumn(name, F.col(name).cast("long"))


def range_join(
    points: DataFrame,
    ranges: DataFrame,
    keys: Sequence[str],
    pos: str,
    low: str,
    high: str,
    block: int = 1024,
    how: str = "inner",
) -> DataFrame:
    """Join each point to the ranges of its key that contain it.

    Ranges are repeated once per position block they touch, so the join key is
    ``(key, block)``: a plain equi join with a short residual test, even when one
    key owns a large share of all points.
    """
    p = points.withColumn("_blk", F.floor(F.col(pos) / F.lit(block)).cast("long"))
    spread = F.sequence(
        F.floor(F.col(low) / F.lit(block)).cast("long"), F.floor(F.col(high) / F.lit(block)).cast("long")
    )
    g = ranges.filter(F.col(low) <= F.col(high)).withColumn("_gb", F.explode(spread))
    for k in keys:
        g = g.withColumnRenamed(k, f"_k_{k}")
    cond = (p["_blk"] == g["_gb"]) & p[pos].between(g[low], g[high])
    for k in keys:
        cond = cond & (p[k] == g[f"_k_{k}"])
    return p.join(g, cond, how).drop("_blk", "_gb", *[f"_k_{k}" for k in keys])
