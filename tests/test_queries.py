"""Every query with SQL, against DuckDB on the smallest tables."""

import glob
import inspect
import math
import os

import duckdb
import pytest

import __spark_entry__
from tidemark.operators import metrics
from tidemark.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    return (None if math.isnan(v) else round(v, 9) + 0.0) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, tables, name):
    got = QUERIES[name](spark, SF)
    want = tables.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_studies_have_their_whole_size(spark, monkeypatch):
    assert {r.n_valid for r in QUERIES["paired_bootstrap"](spark, SF).collect()} == {500}
    assert sorted(r.repeat for r in QUERIES["block_shuffle"](spark, SF).collect()) == list(range(50))
    assert {r.feature for r in QUERIES["permutation_importance"](spark, SF).filter("deviation > 0").collect()} == {"a", "b"}
    fitted = []
    real = metrics.boosted_trees

    def spy(train, test, *args, **kwargs):
        bound = inspect.signature(real).bind(train, test, *args, **kwargs)
        bound.apply_defaults()
        fitted.append((bound.arguments["trees"], bound.arguments["depth"]))
        return test, {}

    monkeypatch.setattr(metrics, "boosted_trees", spy)
    QUERIES["boosted_trees"](spark, SF)
    assert fitted == [(100, 5)]
