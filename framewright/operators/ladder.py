"""Ladders of variants: which there are, in what order, and which is playing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..common import unused
from .lookup import first_per_key


def ladder(variants: DataFrame, group: Sequence[str], order: str) -> DataFrame:
    """variants: group, order, height, bandwidth, codec (of a stream's manifest).  Adds rung, from 0 up.

    Only video counts: a height, a bandwidth of video or a codec.  Of variants of one height (or else of one bandwidth) the
    first stays.  Rungs go by height and then bandwidth; those without a height come first.
    """
    video = variants.filter(F.col("height").isNotNull() | F.col("bandwidth").isNotNull() | (F.coalesce("codec", F.lit("")) != ""))
    size, = unused(variants.columns, "size")
    video = video.withColumn(size, F.when(F.col("height").isNotNull(), F.concat(F.lit("h"), "height")).otherwise(F.concat(F.lit("b"), F.coalesce("bandwidth", F.lit(0)))))
    one = first_per_key(video, [*group, size], [order]).drop(size)
    w = Window.partitionBy(*group).orderBy(F.col("height").asc_nulls_first(), F.col("bandwidth").asc_nulls_first(), order)
    return one.withColumn("rung", F.row_number().over(w) - 1)


def active_rung(sessions: DataFrame, rungs: DataFrame, group: Sequence[str]) -> DataFrame:
    """sessions: group, height, bandwidth of what plays.  Adds rung: that of its height, or else its bandwidth, or else the top."""
    top, h, b = unused(sessions.columns, "top", "by_height", "by_bandwidth")
    tops = rungs.groupBy(*group).agg(F.max("rung").alias(top))
    by_height = rungs.filter("height is not null").groupBy(*group, "height").agg(F.min("rung").alias(h))
    by_bandwidth = rungs.filter("bandwidth is not null").groupBy(*group, "bandwidth").agg(F.min("rung").alias(b))
    got = sessions.join(by_height, [*group, "height"], "left").join(by_bandwidth, [*group, "bandwidth"], "left").join(tops, list(group), "left")
    return got.withColumn("rung", F.coalesce(h, b, top)).drop(h, b, top)


def cap_as_bandwidth(decisions: DataFrame, rungs: DataFrame, group: Sequence[str]) -> DataFrame:
    """What a player is told: the bandwidth and height of the cap's rung, and whole kilobits, rounded up; null without a cap."""
    told = rungs.select(*group, F.col("rung").alias("cap"), F.col("bandwidth").alias("max_bandwidth"), F.col("height").alias("max_height"))
    return decisions.join(told, [*group, "cap"], "left").withColumn("max_kbps", F.ceil(F.col("max_bandwidth") / 1000))


def applied(decisions: DataFrame, rungs: DataFrame, group: Sequence[str]) -> DataFrame:
    """What each kind of player is told of a decision (group, cap, reason): adds apply, and player settings where it applies.

    One limits height and bandwidth, one whole kilobits, one names a level.  A cap is applied when it changes; one that isn't on the
    ladder can't be and is `reverted`: the controller takes it back.
    """
    told = cap_as_bandwidth(decisions, rungs, group)
    change = needs_change(F.col("reason"))
    there = F.col("max_bandwidth").isNotNull() | F.col("max_height").isNotNull()
    return told.select(
        *decisions.columns, (change & there).alias("apply"), (change & ~there).alias("reverted"),
        F.when(change, F.col("max_height")).alias("max_height"), F.when(change, F.col("max_bandwidth")).alias("max_bandwidth"),
        F.when(change, F.col("max_kbps")).alias("max_kbps"), F.when(change & there, F.col("cap")).alias("level"),
    )


def needs_change(reason: Column) -> Column:
    return reason.isin("lower", "raise")
