"""Ordered scans of keys of any size: one key's rows are many tasks' work.

A window gives all rows of a key to one task.  Here they are cut in parts by ranges of their order: each part is summed up, the summaries of the parts
before it are put together, and a pass over each part alone does the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..common import unused, with_groups
from ..scratch import keep


class Parts:
    """The rows of a table in parts; scans add columns, done() gives the rows.

    keys, order: columns; ascending, nulls first, null keys are one key.  Rows of equal order are in one part, and as ever in no order among
    themselves.  The rows are written to the shared folder once, so that parts stay what they are; what is shuffled afterwards are rows by (key,
    part), and a summary for each of these.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str]):
        self.keys, self.order, self.columns = list(keys), list(order), df.columns
        self.part, = unused(df.columns, "part")
        rows = df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in (*keys, *order)])
        self.rows = keep(rows.withColumn(self.part, F.spark_partition_id()))

    def _here(self, through: bool):
        return Window.partitionBy(*self.keys, self.part).orderBy(*self.order).rowsBetween(Window.unboundedPreceding, 0 if through else -1)

    def _before(self, summary: Column, name: str, put) -> DataFrame:
        """keys, part and what `put` makes of the summaries of a key's parts before this one, as `name`."""
        w = Window.partitionBy(*self.keys).orderBy(self.part).rowsBetween(Window.unboundedPreceding, -1)
        sums = self.rows.groupBy(*self.keys, self.part).agg(summary.alias(name))
        return keep(sums.withColumn(name, put(F.col(name)).over(w)))

    def _with(self, name: str, value: Column) -> None:
        self.rows = self.rows.withColumn(name, value)
        self.columns = [*self.columns, name] if name not in self.columns else self.columns

    def running_sum(self, value: Column, name: str, through: bool = True) -> Parts:
        """The sum up to each row, or up to the one before it; 0 where there is nothing."""
        own, = unused([*self.rows.columns, name], "before")
        before = self._before(F.sum(value), own, F.sum)
        self._with(name, F.coalesce(F.sum(value).over(self._here(through)), F.lit(0)))
        joined = with_groups(self.rows, before, [*self.keys, self.part], [own])
        self.rows = joined.withColumn(name, F.col(name) + F.coalesce(own, F.lit(0))).drop(own)
        return self

    def carried(self, value: Column, name: str, through: bool = True) -> Parts:
        """The last value that isn't null up to each row, or up to the one before it."""
        own, = unused([*self.rows.columns, name], "before")
        last = F.max_by(value, F.when(value.isNotNull(), F.struct(*self.order)))
        before = self._before(last, own, lambda c: F.last(c, ignorenulls=True))
        self._with(name, F.last(value, ignorenulls=True).over(self._here(through)))
        joined = with_groups(self.rows, before, [*self.keys, self.part], [own])
        self.rows = joined.withColumn(name, F.coalesce(name, own)).drop(own)
        return self

    def done(self, *without: str) -> DataFrame:
        return self.rows.select(*(c for c in self.columns if c not in without))


def sequence_number(df: DataFrame, partition: Sequence[str], order: Sequence[str], starts: Column, name: str = "seq") -> DataFrame:
    """ordering.sequence_number for keys of any size."""
    return Parts(df, partition, order).running_sum(F.when(starts, 1).otherwise(0), name).done()


def numbered(df: DataFrame, partition: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Adds each row's number from 0 in its key's order, which must be without ties."""
    return Parts(df, partition, order).running_sum(F.lit(1), name, through=False).done()


def inherit(df: DataFrame, partition: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """lookup.inherit for keys of any size."""
    return Parts(df, partition, order).carried(value, name).done()


def unwrap_counter(
    df: DataFrame, partition: Sequence[str], order: Sequence[str], low_bits: str, modulus: int, anchors: Column, resets: Column, name: str = "full"
) -> DataFrame:
    """ordering.unwrap_counter for keys of any size: three scans.

    A reset row is an anchor of 0, so the anchor before a row is carried to it across runs alike; how often the counter has wrapped is the sum of all steps
    less that at the run's reset.
    """
    prev, by, total, base = unused([*df.columns, name], "prev", "step", "total", "base")
    low, half = F.col(low_bits), modulus // 2
    anchors, resets = F.coalesce(anchors, F.lit(False)), F.coalesce(resets, F.lit(False))
    p = Parts(df, partition, order).carried(F.when(resets, 0).when(anchors, low), prev, through=False)
    at = F.coalesce(prev, F.lit(0))
    step = F.when((low < at) & (at - low >= half), modulus).when((low > at) & (low - at > half), -modulus).otherwise(0)
    p._with(by, F.when(resets, 0).otherwise(step))
    p.running_sum(F.when(anchors & ~resets, F.col(by)).otherwise(0), total, through=False)
    p.carried(F.when(resets, F.col(total)), base)
    high = F.col(total) - F.coalesce(base, F.lit(0))
    p._with(name, F.when(resets, low).otherwise(high + F.col(by) + low).cast("long"))
    return p.done(prev, by, total, base)


def as_of(facts: DataFrame, versions: DataFrame, keys: Sequence[str], order: Sequence[str], take: Sequence[str]) -> DataFrame:
    """lookup.as_of for keys of any size: both sides are cut in the same ranges of order, and each range's last version is carried forward."""
    cols = [*keys, *order]
    rest = [c for c in facts.columns if c not in cols]
    side, fact, version = unused(cols, "side", "fact", "version")
    held = F.struct(*rest) if rest else F.struct(F.lit(True).alias("there"))
    a = facts.select(*cols, F.lit(0).alias(side), held.alias(fact), F.lit(None).alias(version))
    b = versions.select(*cols, F.lit(1).alias(side), F.lit(None).alias(fact), F.struct(*take).alias(version))
    # at equal positions facts come first, so that they don't see those versions
    found, = unused([*cols, side, fact, version], "found")
    both = Parts(a.unionByName(b), keys, [*order, side]).carried(F.col(version), found).done().filter(F.col(side) == 0)
    return both.select(*cols, *[F.col(fact)[c].alias(c) for c in rest], *[F.col(found)[c].alias(f"asof_{c}") for c in take])
