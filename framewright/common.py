"""What the operators have in common: shipping the package to workers, unclaimed column names, and ordered folds."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from pathlib import Path
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_ROOT = str(Path(__file__).resolve().parents[1])


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join(p for p in [_ROOT, *paths] if p)


def unused(columns: Sequence[str], *names: str) -> list[str]:
    """The names, with underscores before those that columns has, in any case."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def with_groups(df: DataFrame, groups: DataFrame, keys: Sequence[str], take: Sequence[str]) -> DataFrame:
    """df with the columns `take` of the one row of groups that has its keys; null equals null."""
    own = unused([*df.columns, *take], *(f"key{i}" for i in range(len(keys))))
    right = groups.select(*(F.col(k).alias(o) for k, o in zip(keys, own)), *take)
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, own)), F.lit(True))
    return df.join(right, same, "left").drop(*own)


def spread(df: DataFrame) -> DataFrame:
    """df's rows dealt evenly over tasks, before work that takes far longer than reading or moving them: a small file is one task otherwise, whatever its rows ask for."""
    spark = df.sparkSession
    return df.repartition(4 * spark.sparkContext.defaultParallelism)


class Fold(Protocol):
    """What is done with the rows of one key, in order; each step gives rows of the result."""

    def row(self, *values) -> list[tuple]: ...

    def end(self) -> list[tuple]: ...


def folded(df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str], make: Callable[[object], Fold], schema: str) -> DataFrame:
    """Folds the rows of each key in order: make(key), then row(values of columns) for each, then end().

    Rows are dealt by key and sorted; a task streams through them and holds what one Fold holds.  Values reach the fold as they
    are, so integers beside nulls keep all their digits.  Rows of null key are one key's.
    """
    ship(df.sparkSession)
    to = to_arrow_schema(StructType.fromDDL(schema))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [[]] * len(to)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, to)], schema=to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fold = None, None
        for b in batches:
            for at in range(0, b.num_rows, 10_000):
                out: list[tuple] = []
                for k, *values in zip(*(c.to_pylist() for c in b.slice(at, 10_000).columns)):
                    if fold is None or k != now:
                        if fold is not None:
                            out += fold.end()
                        now, fold = k, make(k)
                    out += fold.row(*values)
                yield batch(out)
        if fold is not None:
            yield batch(fold.end())

    rows = df.repartition(key).sortWithinPartitions(key, *order).select(key, *columns)
    return rows.mapInArrow(run, StructType.fromDDL(schema))
