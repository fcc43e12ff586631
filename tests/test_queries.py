"""Every query with SQL against DuckDB on the smallest tables; the others run."""

import duckdb
import pytest

import __spark_entry__
from kinetrace.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(table):
    names = sorted(table.column_names)
    plain = lambda x: float(x) if hasattr(x, "as_tuple") else x
    return sorted(repr(tuple(plain(r[c]) for c in names)) for r in table.to_pylist())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_agrees(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toArrow(), duck.sql(ORACLE_SQL[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_others_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_passing_objects_sends_little_to_the_driver(spark):
    spark.sparkContext.setJobGroup("passing_objects", "")
    QUERIES["passing_objects"](spark, SF).write.format("noop").mode("overwrite").save()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("passing_objects")) < 30  # with a round of jobs and broadcasts for each step of a label it was a hundred


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLE_SQL) <= set(__spark_entry__.oracle_sql())
