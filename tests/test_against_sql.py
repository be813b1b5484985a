"""Every registered query against its SQL form on the smallest tables."""

import os

import pytest

import __spark_entry__  # noqa: F401  (registers the queries)
from checks.registry import QUERIES, SQL
from checks.compare import compare, duck

FOLDER = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are not here")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    line = compare(spark, con, FOLDER, name, QUERIES[name], SQL.get(name))
    assert not line.startswith("FAIL"), line


def test_plans_have_no_nested_loops(spark):
    for name in ("g4_sparse_top_k", "g5_keyword_under_access", "h12_entity_lookup", "e5_keywords_with_alias_table", "g1_visible_documents"):
        plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name


def test_top_k_limits_before_the_shuffle(spark):
    plan = QUERIES["g5_keyword_top_k"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
