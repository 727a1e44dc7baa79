"""Every catalogue query against its SQL equivalent."""

import datetime as dt
import glob
import os

import duckdb
import pytest
from conftest import DATA

from lathework import catalogue


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v.isoformat() if isinstance(v, dt.datetime) else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_matches_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    expected = duck.sql(catalogue.ORACLE[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    at = [expected.columns.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in expected.fetchall()), key=repr)
    assert sorted((tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=repr) == want


def test_plans_push_down(spark):
    plan = catalogue.QUERIES["where_gt"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(c_acctbal,5000.0)" in plan and "ReadSchema: struct<c_custkey:bigint,c_acctbal:double>" in plan
    plan = catalogue.QUERIES["exists"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


def test_entry_survives_without_the_corpus_folders(spark):
    import __spark_entry__

    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(catalogue.OBJECTS))
def test_text_gives_the_same_rows(spark, name):
    """The text back-end's Spark SQL against the compiled plan."""
    if name.startswith("sequence"):
        pytest.skip("Spark SQL has no sequences")
    for f in glob.glob(f"{DATA}/*.parquet"):
        spark.read.parquet(f).createOrReplaceTempView(os.path.basename(f)[:-8])
    make, params = catalogue.OBJECTS[name]
    made = make().generate("spark", params)
    rows = lambda df: sorted((tuple(plain(v) for v in r) for r in df.collect()), key=repr)
    assert rows(spark.sql(made.sql, args=made.params)) == rows(catalogue.QUERIES[name](spark, DATA))
