"""Every registered query that has SQL gives DuckDB's result on the smallest tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import connect, ordered_rows
from tracelattice.plans.oracle import ORACLE
from tracelattice.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not present")


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


def test_entry(spark):
    df = entry(spark)
    assert df.count() > 0 and df.columns[0] == "group_id"


def test_only_model_queries_lack_sql():
    assert set(QUERIES) - set(ORACLE) == {
        "svd_embedding", "one_class_scores", "temporal_fusion_scores", "timed_edge_fit", "warmed_losses", "grid_losses",
    }
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, db, name):
    df = queries()[name](spark, FOLDER)
    result = db.sql(oracle_sql()[name])
    want, columns = result.fetchall(), result.columns
    order = sorted(columns)
    assert sorted(df.columns) == order
    assert ordered_rows(df.collect(), df.columns, order) == ordered_rows(want, columns, order)
