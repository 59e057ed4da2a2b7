"""The contract with the driver: names, and results against SQL on the smallest tables, where they are there."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(_plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    order = [rel.columns.index(c) for c in columns]
    mine = Counter(repr(tuple(map(_plain, r))) for r in df.select(*columns).collect())
    theirs = Counter(repr(tuple(_plain(r[i]) for i in order)) for r in rel.fetchall())
    assert mine == theirs
