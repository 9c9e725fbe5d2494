"""Comparing frames, and summing up runs."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

from ..common import folded


def frame_difference(a: Column, b: Column, peak: float) -> Column:
    """Of two sample arrays: largest difference, samples that differ, the first of them (from 0), and PSNR (infinite if none)."""
    d = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    square = F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x)
    first = F.array_position(F.transform(d, lambda x: x > 0), F.lit(True)) - 1
    return F.struct(
        F.array_max(d).alias("max_abs"),
        F.size(F.filter(d, lambda x: x > 0)).alias("n_diff"),
        F.when(first >= 0, first).alias("first_diff"),
        F.when(square == 0, F.lit(float("inf"))).otherwise(10 * F.log10(F.lit(float(peak) ** 2) / (square / F.size(d)))).alias("psnr"),
    )


def reconcile(test: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """Which frames either side lacks: key, in_test, in_reference."""
    a, b = test.select(key).withColumn("in_test", F.lit(True)), reference.select(key).withColumn("in_reference", F.lit(True))
    return a.join(b, key, "full").select(key, F.coalesce("in_test", F.lit(False)).alias("in_test"), F.coalesce("in_reference", F.lit(False)).alias("in_reference"))


def best_of(df: DataFrame, key: list[str], seconds: str) -> DataFrame:
    return df.groupBy(*key).agg(F.min(seconds).alias("best"), F.avg(seconds).alias("mean"), F.count(F.lit(1)).alias("runs"))


def digest(df: DataFrame, key: str, order: list[str], content: str) -> DataFrame:
    """MD5 of each key's content (binary or string) in order: key, digest, bytes.  A task streams through it and holds 16 bytes; nulls add nothing."""

    class Md5:
        def __init__(self, k):
            self.key, self.of, self.n = k, hashlib.md5(usedforsecurity=False), 0

        def row(self, x):
            x = x.encode() if isinstance(x, str) else x or b""
            self.of.update(x)
            self.n += len(x)
            return []

        def end(self):
            return [(self.key, self.of.hexdigest(), self.n)]

    return folded(df, key, order, [content], Md5, f"`{key}` {dict(df.dtypes)[key]}, digest string, bytes long")


def any_of(df: DataFrame, key: list[str], flag: Column, name: str = "any") -> DataFrame:
    """Whether the flag holds for any row of each key."""
    return df.groupBy(*key).agg(F.coalesce(F.bool_or(flag), F.lit(False)).alias(name))


def speed(total_ms: Column, duration_ms: Column) -> Column:
    """Media time over processing time; null where no time was taken: such a segment publishes nothing, so filter nulls out before summing up."""
    return F.when(total_ms > 0, duration_ms / total_ms)
