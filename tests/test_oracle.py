"""Every registered query against its SQL on the small driver tables."""

from __future__ import annotations

import os

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry
import workload
from cohortloom.operators.skew import RANGE_ROWS_CONF

FOLDER = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")
# The queries of the training-data subpackage have tests of their own.
QUERIES, ORACLE = workload.QUERIES, workload.ORACLE
# Queries whose plan changes when groups are split.
SPLIT = ["group_any_flag", "priority_sort", "lag_days", "baseline_diff", "trajectory_multi", "trajectory_score",
         "freq_multi", "describe_numeric", "regroup_sizes"]
# Empty on the smallest tables.
MAY_BE_EMPTY = {"indicator_05", "indicator_11", "indicator_04", "indicator_03", "indicator_12", "indicator_02"}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    problem = compare(spark, con, FOLDER, name, QUERIES[name], ORACLE.get(name))
    if problem == "no rows on either side" and name in MAY_BE_EMPTY:
        pytest.skip("no rows at this scale")
    assert problem == ""


@pytest.mark.parametrize("name", SPLIT)
def test_query_with_split_groups(spark, con, name):
    spark.conf.set(RANGE_ROWS_CONF, "10")
    try:
        assert compare(spark, con, FOLDER, name, QUERIES[name], ORACLE[name]) == ""
    finally:
        spark.conf.unset(RANGE_ROWS_CONF)


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["kind", "value", "n", "pct_valid", "cum_valid", "pct_total", "cum_total"]
    assert out.count() > 2


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE) and set(QUERIES) <= set(entry.queries())
