"""python -m framewright.cli STREAM -o OUT [--dump-nals] [--dump-headers]: tells what is in byte streams.

STREAM: a file or folder.  OUT: a folder; the tables asked for are written there as JSON lines, by the tasks that make them.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions.syntax import dump_headers
from .operators.pictures import dump_slices
from .operators.sessions import access_units
from .sources import annexb


def dump_units(units: DataFrame) -> DataFrame:
    """What each unit is and which access unit it is in."""
    first = F.expr("shiftright(conv(hex(substring(rbsp, 1, 1)), 16, 10), 7) = 1")
    named = annexb.name_units(access_units(units.withColumn("first_slice", F.coalesce(first, F.lit(False)))))
    return named.select("stream", "nal_idx", "offset", "size", "type", "type_name", "tid", "au_id")


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("stream")
    p.add_argument("-o", "--out", required=True)
    p.add_argument("--dump-nals", action="store_true")
    p.add_argument("--dump-headers", action="store_true")
    a = p.parse_args(args)
    spark = spark or SparkSession.builder.getOrCreate()
    units = annexb.read_streams(spark, a.stream)
    told = {"nals": dump_units(units)} if a.dump_nals else {}
    if a.dump_headers:
        told |= {"headers": dump_headers(units), "slices": dump_slices(units)}
    for name, table in told.items():
        table.repartitionByRange("stream", "nal_idx").sortWithinPartitions("stream", "nal_idx").write.mode("overwrite").json(f"{a.out}/{name}")
    print(f"{units.count()} units")
    return 0


if __name__ == "__main__":
    sys.exit(main())
