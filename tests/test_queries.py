"""Every query with SQL against DuckDB on the smallest tables; every other one for rows and a schema."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from quizloom.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        path = f"{DIR}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/*.parquet')" if os.path.isdir(path) else f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def cell(x):
    if x is None or x is pd.NaT or x is pd.NA or x != x:
        return "NULL"
    return format(x, ".10g") if isinstance(x, float) else str(int(x)) if isinstance(x, bool) else str(x)


def canonical(frame):
    columns = sorted(frame.columns)
    return sorted(tuple(cell(x) for x in row) for row in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, DIR).toPandas(), duck.execute(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_rows_only(spark, name):
    assert catalogue.QUERIES[name](spark, DIR).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["a04_task_progress", "w04_breadcrumb", "w05_item_segments", "t12_outline_chunks"])
def test_order_of_rows_does_not_matter(spark, name, tmp_path):
    for table in ("orders", "documents"):
        spark.read.parquet(f"{DIR}/{table}.parquet").repartition(7).write.parquet(f"{tmp_path}/{table}.parquet")
    assert canonical(catalogue.QUERIES[name](spark, str(tmp_path)).toPandas()) == canonical(catalogue.QUERIES[name](spark, DIR).toPandas())


def test_the_sort_is_in_the_order_of_the_sql(spark, duck):
    got = [r["c_custkey"] for r in catalogue.QUERIES["o06_nulls_natural_sort"](spark, DIR).collect()]
    assert got == duck.execute(catalogue.ORACLE_SQL["o06_nulls_natural_sort"]).df()["c_custkey"].tolist()


def test_chunks_take_one_pass(spark):
    plan = catalogue.QUERIES["t12_outline_chunks"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 1 and plan.count("FileScan parquet") == 1
