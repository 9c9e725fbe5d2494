"""Integer and bit arithmetic as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clip(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, x))


def round_half_up(x: Column) -> Column:
    """Rounds halves towards plus infinity; Spark's round() takes them away from zero."""
    return F.floor(x + 0.5)


def bit_length(x: Column) -> Column:
    """Bits of a positive number."""
    return F.length(F.bin(x))


def ue_length(x: Column) -> Column:
    """Bits of the unsigned Exp-Golomb code of x >= 0."""
    return 2 * bit_length(x + 1) - 1


def ue_code(x: Column) -> Column:
    """The unsigned Exp-Golomb code of x >= 0 as a string of 0 and 1."""
    b = F.bin(x + 1)
    return F.concat(F.repeat(F.lit("0"), F.length(b) - 1), b)


def ue_value(code: Column) -> Column:
    """The number whose code this is."""
    zeros = F.length(F.regexp_extract(code, "^0*", 0))
    return F.conv(F.substring(code, zeros + 1, zeros + 1), 2, 10).cast("long") - 1


def se_value(k: Column) -> Column:
    """The signed number that the unsigned one k stands for: 0, 1, -1, 2, -2, ..."""
    return F.when(k % 2 == 1, F.floor((k + 1) / 2)).otherwise(-F.floor(k / 2)).cast("long")


def wrap16(x: Column) -> Column:
    """x as a signed 16-bit number, modulo 2^16."""
    return (F.pmod(x + 32768, F.lit(65536)) - 32768).cast("int")


def ceil_log2(x: Column) -> Column:
    return F.when(x <= 1, 0).otherwise(bit_length(x - 1))
