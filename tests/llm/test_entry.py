import glob
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    found = [re.match(r"op(\d+)_\w+$", n) for n in entry.queries()]
    assert sorted(int(m[1]) for m in found if m) == list(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", ["op1_url_filter", "op2_exact_dedup", "op13_merkle_manifest"])
def test_equals_sql(spark, name):
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    got, want = entry.queries()[name](spark, SF), c.sql(entry.oracle_sql()[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    pick = lambda cols, rows: sorted(repr(tuple(dict(zip(cols, r))[n] for n in names)) for r in rows)
    assert pick(got.columns, got.collect()) == pick(want.columns, want.fetchall())
