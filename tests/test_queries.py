"""Registered queries against their SQL, and those without SQL against their shape."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import gridlore.plans
from gridlore import registry
from tools.compare import tidy

gridlore.plans.load()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_sql(spark, sf, con, name):
    want = con.execute(registry.ORACLE[name])
    df = registry.QUERIES[name](spark, sf)
    a, b = tidy(df.columns, df.collect()), tidy([c[0] for c in want.description], want.fetchall())
    assert list(a.columns) == list(b.columns)
    assert a.equals(b), a.merge(b, how="outer", indicator=True).query("_merge != 'both'").head().to_string()


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_lineup_games_tasks(spark, sf):
    """The rows come from many tasks, however few bytes the join reads."""
    df = registry.QUERIES["join_lineup_games"](spark, sf)
    assert df.select(F.spark_partition_id()).distinct().count() > 16
