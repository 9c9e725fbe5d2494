"""Segments of media from file to file: demultiplexed, put in order, rebased, batched and written as fragments again."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.mp4 import remux, sample_table
from ..streaming.ordered import rebase
from .ordering import durations


def restamped(files: DataFrame, per_fragment: int = 30, start: int | None = None) -> DataFrame:
    """files: path, content.  The video of each file in fragments of per_fragment samples: path, sequence, dts, n, content.

    Samples last to the next one, the last as long as the first; with `start` each file's first sample is moved there.  All a file's
    samples pass through one task at a time, 31 of them held; files are worked on side by side.
    """
    samples = sample_table(files)
    first = samples.groupBy("path").agg(F.min("track").alias("track"))
    one = durations(samples.join(first, ["path", "track"]).withColumnRenamed("duration", "told"), ["path"], ["dts", "index"], "dts")
    one = one.withColumn("duration", F.coalesce("duration", "told")).withColumn("base", F.lit(start).cast("long"))
    return remux(rebase(one, ["path"], "dts", ["dts", "pts"], "base").select("path", "track", "index", "dts", "duration", "key", "data"), per_fragment)


def published(segments: DataFrame, total_ms: str, duration_ms: str) -> DataFrame:
    """Adds speed: media time over processing time.  Segments that took no time publish nothing."""
    return segments.filter(F.col(total_ms) > 0).withColumn("speed", F.col(duration_ms) / F.col(total_ms))
