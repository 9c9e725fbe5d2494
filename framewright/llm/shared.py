"""Helpers that the operators of this subpackage have in common."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..common import ship, unused  # noqa: F401
from ..scratch import clear, drop, keep, shared_dir  # noqa: F401


MOST = (1 << 63) - 1


def place(column: str, salt: str) -> Column:
    """A hash of 63 bits, by which rows are drawn."""
    return F.shiftrightunsigned(F.xxhash64(column, F.lit(salt)), 1)


def share(rows: int, n: int) -> int:
    """Which hash is the largest that is drawn for about `rows` of n to be."""
    return MOST if n <= rows else (rows << 63) // n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_parts(df: DataFrame, part_bytes: int, least: int = 8) -> int:
    """A number of parts of about part_bytes each, in proportion to the input, from how the scan is split."""
    most = df.sparkSession.conf.get("spark.sql.files.maxPartitionBytes", "128m").lower()
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    digits = most.rstrip("b")
    size = int(digits[:-1]) * units[digits[-1]] if digits[-1:] in units else int(digits or 1 << 27)
    return max(least, math.ceil(df.rdd.getNumPartitions() * min(size, 1 << 30) / part_bytes))
