"""Bloom filters made of plain SQL expressions.

A filter is a DataFrame of one row that holds its bits as array<bigint>; expressions read it
through a scalar subquery, so that probing needs neither a join nor Python.  max_bits is the most that
is ever sent to the tasks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .shared import keep

MAX_BITS = 1 << 26  # 8 MB


@dataclass(frozen=True)
class Bloom:
    bits: DataFrame  # one row: bits array<bigint>
    m: int
    k: int
    seed: int

    def might_contain(self, key: Column) -> Column:
        words = self.bits.scalar()
        found = F.lit(True)
        for pos in positions(key, self.m, self.k, self.seed):
            word = F.element_at(words, (F.shiftright(pos, 6) + 1).cast("int"))
            bit = F.pmod(pos, F.lit(64)).cast("int")
            found = found & (F.call_function("bit_get", word, bit) == 1)
        return found


def positions(key: Column, m: int, k: int, seed: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(seed), F.lit(i)), F.lit(m)) for i in range(k)]


def shape(n: int, fpp: float, max_bits: int | None = None) -> tuple[int, int]:
    """Bits (a multiple of 64, max_bits at most) and hash functions for n keys at the false positive rate fpp, or what max_bits allows."""
    n = max(n, 1)
    m = max(64, -(-math.ceil(-n * math.log(fpp) / math.log(2) ** 2) // 64) * 64)
    m = min(m, max(64, max_bits // 64 * 64)) if max_bits else m
    return m, max(1, min(12, round(m / n * math.log(2))))


def build(keys: DataFrame, key: str, n: int, fpp: float, seed: int, max_bits: int = MAX_BITS) -> Bloom:
    """A filter of the n keys in keys[key], of max_bits at most.

    More keys than that holds at fpp let more other keys pass, never fewer of their own: whoever filters by it
    and then joins gets the same rows, by the same plan, at any number of keys.
    """
    m, k = shape(n, fpp, max_bits)
    spark = keys.sparkSession
    words = (
        keys.select(F.explode(F.array(*positions(F.col(key), m, k, seed))).alias("p"))
        .groupBy(F.shiftright("p", 6).alias("w"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("b"))
    )
    dense = spark.range(m // 64).withColumnRenamed("id", "w").join(words, "w", "left")
    row = dense.agg(F.array_sort(F.collect_list(F.struct("w", F.coalesce("b", F.lit(0)).alias("b")))).alias("x"))
    return Bloom(keep(row.select(F.expr("transform(x, y -> y.b)").alias("bits"))), m, k, seed)
