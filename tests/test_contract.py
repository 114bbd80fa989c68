"""The driver's contract: names agree, every query has rows, and SQL gives the same ones."""

import glob
import math
import os

import pytest

import __spark_entry__ as E
from quillmill.plans.queries import QUERIES
from quillmill.plans.sql import SQL

SMALL = "/root/testdata/sf0.001"


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else v
    return sorted(columns), sorted(str([value(r[i]) for i in order]) for r in rows)


def test_names():
    assert set(SQL) == set(QUERIES)
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry(spark):
    assert E.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables are elsewhere")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got = QUERIES[name](spark, SMALL)
    want = con.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert canonical(got.columns, [tuple(r) for r in got.collect()]) == canonical(columns, want.fetchall())
