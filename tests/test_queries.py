"""Every registered query of the pages and scores against its DuckDB SQL, on the smallest tables."""

import glob
import os
from decimal import Decimal

import duckdb
import pytest

from partita.plans.oracle import ORACLE
from partita.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(x):
    if x is None or x != x:
        return None
    return round(float(x), 6) if isinstance(x, (int, float, Decimal)) and not isinstance(x, bool) else x


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in ORACLE:
        assert got
        return
    rel = duck.sql(ORACLE[name])
    assert sorted(rel.columns) == columns
    want = rel.fetchall()
    want = sorted((tuple(plain(dict(zip(rel.columns, r, strict=True))[c]) for c in columns) for r in want), key=repr)
    assert got == want
