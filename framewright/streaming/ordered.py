"""Ordered streams as tables: bounded reordering, generations, time bases, queues, listeners."""

from __future__ import annotations

import heapq
import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..common import folded, unused, with_groups

_log = logging.getLogger(__name__)


class Reorder:
    """Holds `depth` rows of a key back: of more, the one of the smallest position comes out."""

    def __init__(self, key, depth: int):
        self.key, self.depth, self.held, self.n = key, depth, [], 0

    def _out(self, flushed: bool) -> tuple:
        self.n += 1
        return self.key, heapq.heappop(self.held), self.n - 1, flushed

    def row(self, x) -> list[tuple]:
        if x is None:
            return []
        heapq.heappush(self.held, x)
        return [self._out(False)] if len(self.held) > self.depth else []

    def end(self) -> list[tuple]:
        return [self._out(True) for _ in range(len(self.held))]

    def state(self):
        return [self.held, self.n]

    def load(self, state) -> None:
        self.held, self.n = state


def reorder_batch(df: DataFrame, key: str, arrival: str, position: str, depth: int) -> DataFrame:
    """Rows of each key in order of `position`, holding `depth` of them back, and a flush at the end; by sorted partitions and one key's buffer at a time.

    Output: key, position, emitted (running number), and flushed: whether a row came out at the end only.  A row that comes after its place has gone is emitted at
    once; rows of null position are left out.  stateful.reordered does the same on a stream.
    """
    kinds = dict(df.dtypes)
    rows = df.filter(F.col(position).isNotNull())
    return folded(rows, key, [arrival], [position], lambda k: Reorder(k, depth), f"`{key}` {kinds[key]}, `{position}` {kinds[position]}, emitted long, flushed boolean")


def all_frames(drained: DataFrame, flushed: DataFrame) -> DataFrame:
    """What came out on the way and what at the end, as one; `flushed` tells which."""
    return drained.withColumn("flushed", F.lit(False)).unionByName(flushed.withColumn("flushed", F.lit(True)))


def current_generation(df: DataFrame, key: str, generation: str) -> DataFrame:
    """Rows of a key's newest generation: what an older one sends late is discarded.  Rows of null key are one key's; those of null generation go."""
    last, = unused(df.columns, "newest")
    newest = df.groupBy(key).agg(F.max(generation).alias(last))
    return with_groups(df, newest, [key], [last]).filter(F.col(generation) == F.col(last)).drop(last)


def rebase(df: DataFrame, segment: list[str], order: str, times: list[str], base: str) -> DataFrame:
    """Shifts a segment's times so that its first one is `base`, as its first row that has one gives it; without one nothing is shifted.

    One shuffle, by the segment; null segments are one segment.
    """
    by, = unused(df.columns, "shift")
    w = Window.partitionBy(*segment)
    first, to = F.min_by(times[0], order).over(w), F.min_by(base, F.when(F.col(base).isNotNull(), F.col(order))).over(w)
    moved = df.withColumn(by, F.coalesce(first - to, F.lit(0)))
    return moved.select(*[(F.col(c) - F.col(by)).alias(c) if c in times else F.col(c) for c in df.columns])


def repositioned(delta_s: Column, queued: Column, begun: Column, least_s: float = 0.5) -> Column:
    """Whether a change of the time offset means a seek, after which what is queued is to be dropped."""
    return (F.abs(delta_s) >= least_s) & queued & begun


def served(queue: DataFrame, key: str, order: list[str], kind: str) -> DataFrame:
    """A queue worked off one entry at a time.  queue: key, order, kind (init, segment, abort, or null).  Adds generation, init_no and state.

    generation: how many aborts precede the entry; init_no: how many init segments do, itself included, whatever the generation, as
    a new run begins with the last one again.  state: `parsed` for an init segment, `served` for a segment after one, `waiting`
    for a segment before any, `dropped` for a segment that an abort follows before the next entry, else null.
    """
    w = Window.partitionBy(key).orderBy(*order)
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    k = F.col(kind)
    df = queue.withColumn("generation", F.sum(F.when(k == "abort", 1).otherwise(0)).over(past)).withColumn("init_no", F.sum(F.when(k == "init", 1).otherwise(0)).over(past))
    cut = F.coalesce(F.lead(k).over(w) == "abort", F.lit(False))
    segment = F.when(cut, "dropped").when(F.col("init_no") > 0, "served").otherwise("waiting")
    return df.withColumn("state", F.when(k == "init", "parsed").when(k == "segment", segment))


def publish(*listeners: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: hands each micro-batch to every listener in turn; one that raises doesn't keep it from the others."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for f in listeners:
                try:
                    f(batch, number)
                except Exception:
                    _log.exception("a listener failed on micro-batch %d", number)
        finally:
            batch.unpersist()

    return each
