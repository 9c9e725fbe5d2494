"""Grouping ordered records by boundaries in the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..common import unused
from ..functions.media import is_vcl
from .ordering import sequence_number


def boundary_groups(df: DataFrame, partition: Sequence[str], order: Sequence[str], starts: Column, aggregates: Sequence[Column], name: str = "group_no") -> DataFrame:
    """One row per run of records that a boundary record begins."""
    return sequence_number(df, partition, order, starts, name).groupBy(*partition, name).agg(*aggregates)


def access_units(units: DataFrame, partition: Sequence[str] = ("stream",), order: Sequence[str] = ("nal_idx",)) -> DataFrame:
    """Adds au_id, from 0: the access unit that each unit (columns type and first_slice) belongs to.

    A unit begins an access unit if it is the first slice of a picture and the unit's own has a slice already, or if it comes
    right after a slice and is of a kind that stands before slices (delimiter, parameter sets, prefix SEI, end of sequence or stream,
    reserved and unspecified ones).
    """
    w = Window.partitionBy(*partition).orderBy(*order)
    t = F.col("type")
    opens = (t.isin(32, 33, 34, 35, 36, 37, 39) | t.between(41, 63)) & F.coalesce(is_vcl(F.lag(t).over(w)), F.lit(False))
    was, begins = unused(units.columns, "was", "begins")
    df = units.withColumn(was, F.when(is_vcl(t), "slice").when(opens, "opens"))
    before = F.last(was, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = (F.col(was) == "opens") | (is_vcl(t) & F.col("first_slice") & (before == "slice"))
    df = df.withColumn(begins, F.when(starts, 1).otherwise(0))
    return df.withColumn("au_id", F.sum(begins).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop(was, begins)


def pictures(units: DataFrame, partition: Sequence[str] = ("stream",), order: Sequence[str] = ("nal_idx",)) -> DataFrame:
    """Adds picture_id to coded slices: slices up to the next one that begins a picture."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    starts = F.when(is_vcl(F.col("type")) & F.col("first_slice"), 1).otherwise(0)
    return units.withColumn("picture_id", F.when(is_vcl(F.col("type")), F.sum(starts).over(w) - 1))


def join_ranges(ranges: Column, gap: float) -> Column:
    """Buffered ranges (sorted by start) whose gaps are below `gap`, as one."""
    empty = F.expr("cast(array() as array<struct<start:double,end:double>>)")
    return F.aggregate(
        ranges,
        empty,
        lambda acc, r: F.when((F.size(acc) > 0) & (r["start"] - F.try_element_at(acc, F.lit(-1))["end"] < gap), F.concat(
            F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(acc, F.lit(-1))["end"], r["end"]).alias("end")))
        )).otherwise(F.concat(acc, F.array(F.struct(r["start"].cast("double").alias("start"), r["end"].cast("double").alias("end"))))),
    )


def total_buffered(ranges: Column) -> Column:
    return F.aggregate(ranges, F.lit(0.0), lambda s, r: s + (r["end"] - r["start"]))
