"""Every query against the same result in SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"create view {name} as select * from '{path}'")
    yield connection
    connection.close()


def ordered(names, rows):
    columns = sorted(range(len(names)), key=names.__getitem__)
    return sorted(([row[c] for c in columns] for row in rows), key=repr)


def test_every_query_has_its_sql():
    assert set(contract._book_queries()) == set(contract._book_sql())


def test_flagship(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", contract.oracle_sql())
def test_same_as_sql(spark, database, name):
    found = contract.queries()[name](spark, FOLDER)
    rows = found.collect()
    wanted = database.execute(contract.oracle_sql()[name])
    names = [column[0] for column in wanted.description]
    assert sorted(found.columns) == sorted(names)
    assert ordered(found.columns, rows) == ordered(names, wanted.fetchall())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
