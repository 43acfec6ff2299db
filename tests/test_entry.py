"""Every registered query against its oracle on the smallest tables."""

import glob
import os
import sys

import duckdb
import pytest

import __spark_entry__ as entry

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from check_oracles import rows_of  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
LLM = {*(entry.llm.queries() if entry.llm else ()), "pipeline"}
QUERIES = {name: query for name, query in entry.queries().items() if name not in LLM}
ORACLES = {name: sql for name, sql in entry.oracle_sql().items() if name not in LLM}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"create view {name} as select * from '{path}'")
    return connection


def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    result = duck.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, result.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["series", "identifier", "x", "y"] and df.count() > 0
