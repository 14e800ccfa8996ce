"""Every registered query against its SQL on the smallest test tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as spark_entry
from conftest import SF
from tools.check_oracles import compare

SLOW: set[str] = set()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return c


def test_entry(spark):
    df = spark_entry.entry(spark)
    assert df.columns == ["epoch", "dst_addr"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(spark_entry.oracle_sql()) <= set(spark_entry.queries())


@pytest.mark.parametrize("name", [n for n in spark_entry.queries() if n not in SLOW])
def test_query(spark, con, name):
    df = spark_entry.queries()[name](spark, SF)
    verdict = compare(df, con, name)
    assert verdict.startswith(("ok", "rows-only")), verdict
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "NestedLoopJoin" not in plan
