"""Every tabular query against its SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from framewright.plans import media_queries, source_queries, stream_queries
from framewright.plans.media_sql import SQL as MEDIA_SQL
from framewright.plans.queries import queries as ordered_queries
from framewright.plans.source_sql import SQL as SOURCE_SQL
from framewright.plans.sql import SQL as ORDERED_SQL
from framewright.plans.stream_sql import SQL as STREAM_SQL

SF = "/root/testdata/sf0.001"
SQL = ORDERED_SQL | MEDIA_SQL | STREAM_SQL | SOURCE_SQL


def queries():
    return ordered_queries() | media_queries.queries() | stream_queries.queries() | source_queries.queries()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def rows(names, found):
    at = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda x: None if x is None or isinstance(x, float) and math.isnan(x) else round(x, 6) if isinstance(x, float) else x
    return sorted((tuple(plain(r[i]) for i in at) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(queries()))
def test_equals_sql(spark, db, name):
    got, want = queries()[name](spark, SF), db.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())
