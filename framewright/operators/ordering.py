"""Ordered scans over partitioned streams: counters, order, durations, gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..common import unused, with_groups


def sequence_number(df: DataFrame, partition: Sequence[str], order: Sequence[str], starts: Column, name: str = "seq") -> DataFrame:
    """How many rows up to each one start a new sequence."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(w))


def unwrap_counter(
    df: DataFrame, partition: Sequence[str], order: Sequence[str], low_bits: str, modulus: int, anchors: Column, resets: Column, name: str = "full"
) -> DataFrame:
    """Restores a counter of which only the value modulo `modulus` is given.

    Each row is taken to lie within half a modulus of the anchor row before it; a reset row starts anew at its own
    value with the anchor's low part taken as 0.  Plain windows: no Python, no state.
    """
    w = Window.partitionBy(*partition).orderBy(*order)
    run, prev, by = unused(df.columns, "run", "prev", "step")
    df = df.withColumn(run, F.sum(F.when(resets, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    low = F.col(low_bits)
    inside = Window.partitionBy(*partition, run).orderBy(*order)
    anchor_low = F.when(resets, 0).when(anchors, low)
    # low part of the last anchor before each row; 0 where the run has none yet
    df = df.withColumn(prev, F.coalesce(F.last(anchor_low, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    half = modulus // 2
    step = F.when((low < F.col(prev)) & (F.col(prev) - low >= half), modulus).when((low > F.col(prev)) & (low - F.col(prev) > half), -modulus).otherwise(0)
    df = df.withColumn(by, F.when(resets, 0).otherwise(step))
    high = F.coalesce(F.sum(F.when(anchors & ~resets, F.col(by)).otherwise(0)).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = F.when(resets, low).otherwise(high + F.col(by) + low)
    return df.withColumn(name, out.cast("long")).drop(run, prev, by)


def display_order(df: DataFrame, partition: Sequence[str], order: Sequence[str], name: str = "position") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))


def durations(df: DataFrame, partition: Sequence[str], order: Sequence[str], ticks: str, name: str = "duration") -> DataFrame:
    """Time to the next row; the last row of a partition takes the first one's, and a lone row null."""
    w = Window.partitionBy(*partition).orderBy(*order)
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    step = F.lead(ticks).over(w) - F.col(ticks)
    by, = unused(df.columns, "step")
    df = df.withColumn(by, step)
    return df.withColumn(name, F.coalesce(by, F.first(by).over(every))).drop(by)


def contiguous_ranges(df: DataFrame, partition: Sequence[str], order: Sequence[str], value: str, gap) -> DataFrame:
    """Maximal runs whose neighbouring values are at most `gap` apart: start, end, n for each."""
    w = Window.partitionBy(*partition).orderBy(*order)
    far = F.col(value) - F.lag(value).over(w) > gap
    apart, = unused(df.columns, "far")
    marked = df.withColumn(apart, F.when(far, 1).otherwise(0))
    marked = marked.withColumn("range_no", F.sum(apart).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*partition, "range_no").agg(F.min(value).alias("start"), F.max(value).alias("end"), F.count(F.lit(1)).alias("n"))


def rolling_mean(df: DataFrame, partition: Sequence[str], order: Sequence[str], value: str, rows: int, name: str = "mean") -> DataFrame:
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(1 - rows, 0)
    return df.withColumn(name, F.avg(value).over(w))


def batches(df: DataFrame, partition: Sequence[str], order: Sequence[str], size: int, name: str = "batch") -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*partition).orderBy(*order))
    return df.withColumn(name, F.floor((n - 1) / size).cast("int"))


def retained(df: DataFrame, partition: Sequence[str], at: str, keep: Column) -> DataFrame:
    """Rows no older than `keep` before the newest of their partition.  An aggregate and a join, so no partition is sorted; null keys are keys like any other."""
    last, = unused(df.columns, "newest")
    newest = df.groupBy(*partition).agg(F.max(at).alias(last))
    return with_groups(df, newest, partition, [last]).filter(F.col(at) >= F.col(last) - keep).drop(last)
