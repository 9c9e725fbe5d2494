"""Block arithmetic on integer arrays: transforms, scaling, reconstruction, filters.

The 4-point transforms are sums of products with small fixed matrices; those of up to 32 points are folds over a literal matrix.  All are
array expressions, so that they stay in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The 4-point integer cosine and sine transforms.
DCT4 = ((64, 64, 64, 64), (83, 36, -36, -83), (64, -64, -64, 64), (36, -83, 83, -36))
DST4 = ((29, 55, 74, 84), (74, 74, 0, -74), (84, -29, -74, 55), (55, -84, 74, -29))


# The standard's integer cosines at k/64 of a half turn.
COSINES = (64, 90, 90, 90, 89, 88, 87, 85, 83, 82, 80, 78, 75, 73, 70, 67, 64, 61, 57, 54, 50, 46, 43, 38, 36, 31, 25, 22, 18, 13, 9, 4, 0)


def cosine_matrix(n: int) -> list[list[int]]:
    """The n-point integer transform, n = 4, 8, 16 or 32: rows are frequencies."""
    if n not in (4, 8, 16, 32):
        raise ValueError("a transform has 4, 8, 16 or 32 points")

    def at(angle: int) -> int:
        a = angle % 128
        a = min(a, 128 - a)
        return COSINES[a] if a <= 32 else -COSINES[64 - a]

    return [[at(k * (2 * j + 1) * (32 // n)) for j in range(n)] for k in range(n)]


def _times(matrix: list[list[int]], x: Column) -> Column:
    rows = F.array(*(F.array(*map(F.lit, row)) for row in matrix))
    return F.transform(rows, lambda row: F.aggregate(F.zip_with(row, x, lambda a, b: a * b.cast("long")), F.lit(0).cast("long"), lambda s, v: s + v))


def forward(x: Column, n: int) -> Column:
    """The n-point transform of a vector of n, unscaled; longs."""
    return _times(cosine_matrix(n), x)


def inverse(x: Column, n: int, shift: int = 7) -> Column:
    """The transposed matrix times a vector of n, rounded, shifted, and held within 16 bits."""
    across = _times([list(c) for c in zip(*cosine_matrix(n))], x)
    return F.transform(across, lambda v: F.greatest(F.lit(-32768), F.least(F.lit(32767), F.shiftright(v + (1 << (shift - 1)), shift))))


def transform4(x: Column, matrix=DCT4) -> Column:
    """The matrix times a vector of four."""
    return F.array(*(sum((x[j] * F.lit(m) for j, m in enumerate(row)), F.lit(0)) for row in matrix))


def inverse4(x: Column, matrix=DCT4, shift: int = 7) -> Column:
    """The transposed matrix times a vector of four, rounded and shifted."""
    return F.array(*(F.shiftright(sum((x[i] * F.lit(matrix[i][j]) for i in range(4)), F.lit(0)) + (1 << (shift - 1)), shift) for j in range(4)))


def dequantise(levels: Column, scale: Column, shift: int) -> Column:
    """Levels times scale, rounded, shifted, and held within 16 bits."""
    return F.transform(levels, lambda v: F.greatest(F.lit(-32768), F.least(F.lit(32767), F.shiftright(v * scale + (1 << (shift - 1)), shift))))


def reconstruct(prediction: Column, residual: Column, depth: int = 8) -> Column:
    return F.zip_with(prediction, residual, lambda p, r: F.greatest(F.lit(0), F.least(F.lit((1 << depth) - 1), p + r)))


def edge_class(a: Column, c: Column, b: Column) -> Column:
    """Sample offset class of c between its neighbours: 2 plus the signs of its differences."""
    return (2 + F.signum(c - a) + F.signum(c - b)).cast("int")


def block_transform(df: DataFrame, key: str, samples: str, scale: int) -> DataFrame:
    """Each array cut in blocks of four, scaled to integers and transformed: key, block, c0 to c3."""
    n = F.floor(F.size(samples) / 4).cast("int")
    at = df.select(key, samples, F.explode(F.sequence(F.lit(0), n - 1)).alias("block"))
    x = F.transform(F.slice(samples, F.col("block") * 4 + 1, 4), lambda v: F.floor(v.cast("double") * scale + 0.5).cast("int"))
    return at.select(key, "block", transform4(x).alias("c")).select(key, "block", *[F.col("c")[i].alias(f"c{i}") for i in range(4)])
