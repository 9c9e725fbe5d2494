"""Table functions for SQL: register(spark), then `FROM t, LATERAL length_prefixed(t.data, 4)` or `FROM stream_digest(TABLE(t))`."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from ..common import ship
from . import annexb, mp4


class LengthPrefixed:
    """The units of length-prefixed data: i, unit.  size: how many bytes a length has, 1, 2 or 4.  Null data has none; a unit that is cut off ends them."""

    @staticmethod
    def analyze(data: AnalyzeArgument, size: AnalyzeArgument) -> AnalyzeResult:
        if size.isConstantExpression and size.value not in (1, 2, 4):
            raise ValueError("lengths have 1, 2 or 4 bytes")
        return AnalyzeResult(StructType().add("i", IntegerType()).add("unit", BinaryType()))

    def eval(self, data, size) -> Iterator[tuple]:
        yield from enumerate(annexb.length_prefixed(bytes(data or b""), size))


class ParameterSets:
    """The parameter sets in the first decoder configuration record of data: i, type, unit."""

    @staticmethod
    def analyze(data: AnalyzeArgument) -> AnalyzeResult:
        return AnalyzeResult(StructType().add("i", IntegerType()).add("type", IntegerType()).add("unit", BinaryType()))

    def eval(self, data) -> Iterator[tuple]:
        for i, (kind, unit) in enumerate(mp4.parameter_sets(bytes(data or b""))):
            yield i, kind, unit


class AudioConfig:
    """The decoder-specific bytes of an elementary stream descriptor: one row, or none."""

    @staticmethod
    def analyze(esds: AnalyzeArgument) -> AnalyzeResult:
        return AnalyzeResult(StructType().add("config", BinaryType()))

    def eval(self, esds) -> Iterator[tuple]:
        found = mp4.audio_config(bytes(esds or b""))
        if found is not None:
            yield (found,)


class StreamDigest:
    """MD5 of each key's content in order.  Its table has columns key, at and content (a string); it is partitioned by key and sorted by at."""

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable or not {"key", "at", "content"} <= {f.name for f in table.dataType.fields}:
            raise ValueError("stream_digest takes a table with columns key, at and content")
        out = StructType().add("key", table.dataType["key"].dataType).add("digest", StringType()).add("bytes", LongType())
        return AnalyzeResult(out, partitionBy=[PartitioningColumn("key")], orderBy=[OrderingColumn("at")])

    def __init__(self):
        self.key, self.of, self.n, self.any = None, hashlib.md5(usedforsecurity=False), 0, False

    def eval(self, row):
        self.any, self.key = True, row["key"]
        content = (row["content"] or "").encode()
        self.of.update(content)
        self.n += len(content)

    def terminate(self) -> Iterator[tuple]:
        if self.any:
            yield self.key, self.of.hexdigest(), self.n


FUNCTIONS = {"length_prefixed": LengthPrefixed, "parameter_sets": ParameterSets, "audio_config": AudioConfig, "stream_digest": StreamDigest}


def register(spark: SparkSession) -> None:
    """Makes the table functions known to a session's SQL, by the names in FUNCTIONS."""
    ship(spark)
    for name, made in FUNCTIONS.items():
        spark.udtf.register(name, udtf(made))
