"""Every registered panel query against its SQL twin, at the smallest size."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else v


#: Columns without a value in the smallest tables, where dates are too thin or the column is missing by design.
EMPTY = {"adjusted_bars": {"open"}, "cross_asset_ratios": {"ae_z"}, "rolling_correlation": {"corr"}, "return_spreads": {"ae_cum_60", "ae_cum_120", "ae_z_60", "ae_slope_20", "ae_slope_60"}, "equal_weight_spread": {"bm_z_60"}}


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, duck, small, name):
    got = QUERIES[name](spark, small)
    columns = sorted(got.columns)
    rows = got.collect()
    assert {c for c in columns if rows and all(plain(r[c]) is None for r in rows)} <= EMPTY.get(name, set())
    a = sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=repr)
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    b = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert a == b


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
