"""Every registered query against its DuckDB SQL on sf0.01 (rows, columns, values)."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from setsift.plans.catalog import QUERIES, oracle
from conftest import SF01

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = oracle()
SLOW = {"supervised_scores"}


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    return v


def _key(row):
    """Missing values first."""
    return tuple((v is not None, v) if v is not None else (False, 0) for v in row)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    return con


def test_every_query_has_oracle_or_is_documented():
    assert set(QUERIES) - set(SQL) <= SLOW


@pytest.mark.skipif(not os.path.exists(SF01), reason="no test data")
@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_duckdb(spark, duck, name):
    df = QUERIES[name](spark, SF01)
    cols = df.columns
    srows = sorted((tuple(_norm(r[c]) for c in sorted(cols)) for r in df.collect()), key=_key)
    res = duck.execute(SQL[name])
    dcols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(dcols)
    idx = [dcols.index(c) for c in sorted(cols)]
    drows = sorted((tuple(_norm(r[i]) for i in idx) for r in res.fetchall()), key=_key)
    assert len(srows) == len(drows)
    assert srows == drows
