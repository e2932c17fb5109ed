"""Queries that cut several tables from one work that one out once, before what they return."""

import pytest

import __spark_entry__
from tidewrack.session import drop_scratch


@pytest.mark.parametrize(("query", "column"), [("source_map_renames", "o_orderkey"), ("namespace_names", "l_orderkey")])
def test_shared_rows_are_stored(spark, query, column):
    plan = __spark_entry__.queries()[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    drop_scratch(spark)
    assert f"Relation [{column}#" not in plan and "Relation [" in plan
