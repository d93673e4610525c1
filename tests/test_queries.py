"""Every operator query against its DuckDB text on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from mobilome_spark.plans import driver_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def rows(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    plain = lambda x: None if x is None or x is pd.NA or x != x else float(x) if isinstance(x, (int, float)) else x
    return sorted((tuple(plain(x) for x in r) for r in frame[columns].astype(object).itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(driver_queries.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got = driver_queries.queries()[name](spark, SF).toPandas()
    want = duck.execute(driver_queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_no_nested_loops(spark):
    for name in ("q_tightest_interval", "q_overlap_semi", "q_best_overlap", "q_nearest_seed"):
        plan = driver_queries.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan, name
