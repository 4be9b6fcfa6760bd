"""Plan properties: no Python UDF anywhere, pruned scans, how often tables are read and rows exchanged."""

import re

import pytest

import __spark_entry__ as E
from conftest import SF001
from setsift.operators.truth_table import truth_table
from setsift.plans.catalog import QUERIES

PY = ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas")

#: Scans of driver tables and exchanges of rows in the plan of each query whose work is all in one plan.
COSTS = {
    "truth_table": (1, 3),
    "solutions": (1, 3),
    "prototype_cosine_scores": (1, 0),
    "fuzzy_membership": (1, 0),
    "crisp_membership": (1, 0),
    "qca_ready": (1, 0),
    "top_two_conditions": (1, 0),
    "confidence_counts": (1, 1),
    "score_long": (1, 0),
    "sensitivity_detail": (1, 4),
    "sensitivity_summary": (1, 5),
    "configuration_stability": (1, 5),
    "membership_bins": (1, 2),
    "crisp_domain_report": (1, 2),
    "training_report": (2, 3),
    "tfidf_vocabulary": (1, 2),
}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_udf(spark, name):
    plan = _plan(QUERIES[name](spark, SF001))
    assert not any(p in plan for p in PY), plan


@pytest.mark.parametrize("name", sorted(COSTS))
def test_scans_and_exchanges(spark, name):
    plan = _plan(QUERIES[name](spark, SF001))
    assert len(re.findall(r"FileScan parquet", plan)) <= COSTS[name][0], plan
    assert len(re.findall(r"(?<!Broadcast)Exchange ", plan)) <= COSTS[name][1], plan


@pytest.mark.parametrize("name", ["configuration_members", "prototype_quality"])
def test_the_table_is_read_before_and_its_result_only_joined(spark, name):
    """These write what they have made of the table once; their own plans read no driver table again."""
    assert SF001 not in _plan(QUERIES[name](spark, SF001))


def test_flagship_prunes_columns_and_aggregates_partially(spark):
    plan = _plan(E.entry(spark))
    assert re.findall(r"ReadSchema: struct<([^>]*)>", plan) == ["l_quantity:double,l_discount:double,l_tax:double,l_returnflag:string"]
    assert plan.count("HashAggregate") >= 2  # partial + final


def test_guard_runs_below_the_single_partition(spark):
    df = spark.createDataFrame([(1, 5, 1)], "case_id long, a int, outcome int")
    lines = _plan(truth_table(df, ["a"], sort=False)).splitlines()
    at = lambda word: next(i for i, x in enumerate(lines) if word in x)
    assert at("Window ") < at("SinglePartition") < at("raise_error")
    with pytest.raises(Exception, match="'a' must be 0 or 1"):
        truth_table(df, ["a"]).collect()
