"""Byte streams of units behind start codes: splitting, headers, payloads, and reading them with Spark."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..common import ship
from ..functions.media import is_vcl

SCHEMA = "stream string, nal_idx int, offset long, size long, type int, layer int, tid int, rbsp binary, epb array<long>"


def units(data: bytes) -> list[tuple[int, bytes]]:
    """(offset, unit) for what stands between start codes; trailing zeros are trimmed and units below two bytes dropped."""
    return list(each_unit(data))


def each_unit(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = data.find(b"\0\0\1")
    while at >= 0:
        end = data.find(b"\0\0\1", at + 3)
        unit = data[at + 3 : end if end >= 0 else len(data)].rstrip(b"\0")
        if len(unit) >= 2:
            yield at + 3, unit
        at = end


def header(unit: bytes) -> tuple[int, int, int]:
    """(type, layer, temporal id) of a two-byte header."""
    return unit[0] >> 1 & 63, (unit[0] & 1) << 5 | unit[1] >> 3, (unit[1] & 7) - 1


def payload(unit: bytes) -> tuple[bytes, list[int]]:
    """The bytes after the header without emulation prevention, and where in them such bytes were taken out of."""
    data, out, gone, at = unit[2:], bytearray(), [], 0
    while (hit := data.find(b"\0\0\3", at)) >= 0:
        if hit + 3 >= len(data) or data[hit + 3] <= 3:
            out += data[at : hit + 2]
            gone.append(hit + 2)
            at = hit + 3
        else:
            out += data[at : hit + 3]
            at = hit + 3
    out += data[at:]
    return bytes(out), gone


def plain_offset(coded: int, gone: list[int]) -> int:
    """An offset in coded bytes as one in bytes without emulation prevention."""
    return coded - sum(x < coded for x in gone)


def plain_place(coded: Column, gone: Column) -> Column:
    """plain_offset as an expression; gone: the array epb."""
    return coded - F.size(F.filter(gone, lambda x: x < coded))


def length_prefixed(data: bytes, size: int) -> list[bytes]:
    """Units behind big-endian lengths of `size` bytes; stops at one that is cut off."""
    out, at = [], 0
    while at + size <= len(data):
        n = int.from_bytes(data[at : at + size], "big")
        if at + size + n > len(data):
            break
        out.append(data[at + size : at + size + n])
        at += size + n
    return out


def rows(stream: str, data: bytes) -> Iterator[tuple]:
    for i, (offset, unit) in enumerate(each_unit(data)):
        rbsp, gone = payload(unit)
        yield (stream, i, offset, len(unit), *header(unit), rbsp, gone)


def split_streams(files: DataFrame) -> DataFrame:
    """files: path, content (as binaryFile reads them).  One row per unit; a file is one task's work, its rows stream out."""

    def split(batches):
        import pandas as pd

        for f in batches:
            found = (row for path, content in zip(f["path"], f["content"]) for row in rows(path, bytes(content or b"")))
            while part := list(itertools.islice(found, 1000)):
                yield pd.DataFrame(part, columns=[x.split()[0] for x in SCHEMA.split(", ")])

    ship(files.sparkSession)
    return files.select("path", "content").mapInPandas(split, SCHEMA)


def read_streams(spark: SparkSession, path: str) -> DataFrame:
    """The units of all files at a path that Spark can read."""
    return split_streams(spark.read.format("binaryFile").load(path))


FILES = "path string, modificationTime timestamp, length long, content binary"


def feed_streams(spark: SparkSession, path: str, at_a_time: int = 100) -> DataFrame:
    """As read_streams, of files as they arrive (each holds whole units); a micro-batch takes `at_a_time` at most, so a burst waits its turn."""
    return split_streams(spark.readStream.schema(FILES).format("binaryFile").option("maxFilesPerTrigger", at_a_time).load(path))


def routed(units: DataFrame) -> DataFrame:
    """Adds route: where a unit goes by its type, to the parameter sets, to slice decoding, or nowhere."""
    t = F.col("type")
    return units.withColumn("route", F.when(t.between(32, 34), "parameters").when(is_vcl(t), "slices").otherwise("skipped"))


# What the standard calls the kinds of units.
UNIT_NAMES = {
    0: "TRAIL_N", 1: "TRAIL_R", 2: "TSA_N", 3: "TSA_R", 4: "STSA_N", 5: "STSA_R", 6: "RADL_N", 7: "RADL_R", 8: "RASL_N", 9: "RASL_R",
    16: "BLA_W_LP", 17: "BLA_W_RADL", 18: "BLA_N_LP", 19: "IDR_W_RADL", 20: "IDR_N_LP", 21: "CRA_NUT",
    32: "VPS_NUT", 33: "SPS_NUT", 34: "PPS_NUT", 35: "AUD_NUT", 36: "EOS_NUT", 37: "EOB_NUT", 38: "FD_NUT", 39: "PREFIX_SEI_NUT", 40: "SUFFIX_SEI_NUT",
}


def name_units(df: DataFrame) -> DataFrame:
    """Adds the name of each unit's type: a lookup in a literal map."""
    pairs = [x for k, v in UNIT_NAMES.items() for x in (F.lit(k), F.lit(v))]
    return df.withColumn("type_name", F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("type")), F.lit("UNKNOWN")))
